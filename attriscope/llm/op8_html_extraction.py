"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements and its text blocks, each with its path of
open element names (a rolling hash, so deep pages cost no more than flat ones).  An element is also a token with each word of
its own class and id; no path holds the words of an element around it, so a class or id of one page
(``id="post-123"``) is a token of its own and changes no other.  Pages of one host are compared: tokens with the same
occurrence vector (their count on every page) form an equivalence class.  A
vector is reduced by Spark to a signature, the XOR of hashes of (page, count),
and its support, so no vector or host is ever gathered.  Classes found on all pages of a host form
its template; a class of lower support (``MIN_SUPPORT`` of the pages, which bounds a template to a few pages' tokens) is
nested into it when an element and a text share the vector, that is when a part of the page comes and goes as a whole.

What is left are slots.  The main text is the slot of ``article`` or ``main`` if a page has one, else all slots:

* Outside a main element, a text block of the template is not content.
* Inside one, a text that recurs may be a heading, a byline or a caption of the article, so no block goes by itself.
  A container (``CONTAINERS``) nested in the main element is a token with the digest of all text in it.  If an element shares
  its vector, the same text comes wherever that part of the page comes: it is part of the template, not of the slot,
  and goes as a whole.  A byline differs from that, as its element stands on pages with other names too.
* As a further filter, elements whose name, role or class says menu, header, footer, sidebar, notice, advert, form,
  comments or code are left out of either.

Copies must not make content look like template: pages count once for each
content digest.  With ``article`` or ``main`` it is the smallest hash of ``SHINGLE``
words in a row of that text, which copies share and near copies share nearly always; else the page's bytes.

Edge cases: null or empty html gives the empty text; a host with one
content has no template, and its pages are read by element names alone, and containers inside a main element need
``MIN_MAIN`` different contents; pages whose content is a copy count once in the vectors, with the tokens of all of them; pages without a url
share one host; a host may hold any share of the rows (the join on the host is split by
a salt, their number following the host's rows); unclosed elements end where their parent does; repeated rows get
equal results; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, parts_of, small_batches, stored, table, texts_of
from attriscope.llm.words import Words

MIN_PAGES = 2
MIN_PART = 4
MIN_MAIN = 4
MIN_SUPPORT = 0.3
ELEMENT, TEXT, CONTAINER = 0, 1, 2
PAGE = 0  # stands for the page itself among its tokens: its support is the host's number of pages
SHINGLE = 5
ROWS_A_SALT = 2048
MAX_HOT = 10_000

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("script style noscript template iframe object svg math canvas head title".split())
ASIDE = frozenset("nav footer aside form menu dialog button select textarea".split())
MAIN = frozenset(["article", "main"])
CONTAINERS = frozenset("center details div dl fieldset figure header hgroup ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
P_ENDS = BLOCKS - {"html", "head", "body", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


_MOD, _BASE = (1 << 61) - 1, 0x1D8E4E27C47D124F


class Page(HTMLParser):
    """Blocks (path, text, in main, left out), element tokens and constant-text candidates of one page, in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # element, path hash, in main, left out, blocks before it, whether it is a container inside main
        self.open: list[tuple[str, int, bool, bool, int, bool]] = []
        self.depth: dict[str, int] = {}  # open elements by name
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.sums = [0]  # rolling digest of the first blocks
        self.elements: list[int] = []
        self.containers: list[tuple[int, int, int]] = []  # first block, past the last, token
        self.has_main = False
        self.parts: list[str] = []
        self.feed(html)
        self.close()
        self.flush()
        while self.open:
            self.pop()

    def state(self) -> tuple[str, int, bool, bool, int, bool]:
        return self.open[-1] if self.open else ("", 0, False, False, 0, False)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            _, path, main, out, _, _ = self.state()
            self.blocks.append((path, text, main, out))
            self.sums.append((self.sums[-1] * _BASE + xxhash.xxh64_intdigest(text) + 1) % _MOD)

    def pop(self) -> str:
        tag, path, _, _, first, container = self.open.pop()
        self.depth[tag] -= 1
        past = len(self.blocks)
        if container and past > first:
            digest = (self.sums[past] - self.sums[first] * pow(_BASE, past - first, _MOD)) % _MOD
            self.containers.append((first, past, token("c", path, str(digest))))
        return tag

    def handle_starttag(self, tag, attrs):
        if tag not in BLOCKS and tag not in NOT_TEXT and tag not in ASIDE:
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        if tag in P_ENDS and self.depth.get("p"):
            while self.pop() != "p":
                pass
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.state()[0] == tag:
            self.pop()
        _, path, main, out, _, _ = self.state()
        named = dict(attrs)
        words = re.split(r"[\s_-]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower())
        out = out or tag in NOT_TEXT or tag in ASIDE or (tag == "header" and not main) or (named.get("role") or "").lower() in ROLES
        if tag not in ("html", "body", "article", "main"):
            out = out or not NAMES.isdisjoint(words)
        container = main and not out and tag in CONTAINERS
        if tag in MAIN and not out:
            self.has_main = main = True
        path = xxhash.xxh64_intdigest(tag, seed=path)
        self.elements.append(token("e", path))
        self.elements += [token("e", path, w) for w in dict.fromkeys(words) if w]
        if tag not in VOID:
            self.open.append((tag, path, main, out, len(self.blocks), container))
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag not in BLOCKS and tag not in NOT_TEXT and tag not in ASIDE:
            return
        self.flush()
        if self.depth.get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        self.parts.append(data)

    def main_blocks(self) -> list[str]:
        return [text for _, text, main, out in self.blocks if main and not out]


def token(kind: str, path: int | str, text: str = "") -> int:
    h = xxhash.xxh64_intdigest(f"{kind}|{path}|{text}")
    return h - (1 << 64) if h >= 1 << 63 else h


def content_digests(pages: list[Page], htmls: list[str]) -> list[int]:
    """One number a page that its copies share: the least hash of SHINGLE words in a row of its main element, else a hash of its bytes."""
    out = [token("p", html) for html in htmls]
    texts = [" ".join(page.main_blocks()) for page in pages]
    w = Words(texts)
    h = w.hashes(fold_case=True)
    at, runs = w.windows(h, SHINGLE)
    least = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, w.doc[at], runs)
    for i in np.flatnonzero(np.diff(w.first)):
        short = w.first[i + 1] - w.first[i] < SHINGLE
        out[i] = token("s", texts[i].lower()) if short else int(least[i].astype(np.int64))
    return out


def main_text(html: str, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the main slot that are not template, in page order, joined by a blank line."""
    page = Page(html)
    gone = np.zeros(len(page.blocks) + 1, np.int64)
    for first, past, t in page.containers:
        if t in template:
            gone[first] += 1
            gone[past] -= 1
    gone = np.cumsum(gone)
    keep = []
    for i, (path, text, main, out) in enumerate(page.blocks):
        if out or gone[i] or (page.has_main and not main):
            continue
        if not main and token("t", path, text) in template:
            continue
        keep.append(text)
    return "\n\n".join(keep)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, template): the text and container tokens of each host's template, at most as many as one page has per class level."""
    src = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where("html IS NOT NULL")

    def of_pages(hosts, htmls):
        parsed = [Page(html) for html in htmls]
        for host, page, digest in zip(hosts, parsed, content_digests(parsed, htmls)):
            n: dict[tuple[int, int], int] = {}
            found = [(t, ELEMENT) for t in page.elements] + [(t, CONTAINER) for _, _, t in page.containers]
            # what element names leave out needs no template; texts inside main are no tokens
            found += [(token("t", path, text), TEXT) for path, text, main, out in page.blocks if not out and not main]
            for k in found:
                n[k] = n.get(k, 0) + 1
            if n:
                n[(PAGE, ELEMENT)] = 1
            for (t, kind), c in n.items():
                yield host, digest, t, kind, c

    def tokens(batches):
        for batch in batches:
            hosts, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts_of(htmls):
                cols = list(zip(*of_pages(hosts[part], htmls[part]))) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())],
                    names=["host", "page", "token", "kind", "n"],
                )

    small_batches(pages.sparkSession)
    rows = src.mapInArrow(tokens, "host string, page long, token long, kind int, n long")
    seen = rows.groupBy("host", "page", "token", "kind").agg(F.max("n").alias("n"))  # copies of a page's content count once
    vectors = seen.groupBy("host", "token", "kind").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("support"))
    # text that few pages share can't be template: most rows go here, and pages are parsed once for what follows
    vectors = stored(vectors.where(F.col("support") >= MIN_PAGES), "vectors")
    page = (F.col("token") == PAGE) & (F.col("kind") == ELEMENT)
    sizes = vectors.where(page).select("host", F.col("support").alias("pages"))
    both = vectors.where(~page).join(sizes, "host").where(F.col("support") >= MIN_SUPPORT * F.col("pages"))
    whole, token_of = F.col("support") == F.col("pages"), F.col("token")
    classes = both.groupBy("host", "vector", "support", "pages").agg(
        F.max(F.col("kind") == ELEMENT).alias("has_element"),
        F.collect_set(F.when(F.col("kind") == TEXT, token_of)).alias("texts"),
        F.collect_set(F.when(F.col("kind") == CONTAINER, token_of)).alias("containers"))
    texts = F.when(whole | (F.col("has_element") & (F.col("support") >= MIN_PART)), F.col("texts")).otherwise(F.array().cast("array<long>"))
    parts = F.when(F.col("has_element") & (F.col("support") >= MIN_MAIN), F.col("containers")).otherwise(F.array().cast("array<long>"))
    known = classes.select("host", F.explode(F.concat(texts, parts)).alias("t"))
    return known.groupBy("host").agg(F.collect_set("t").alias("template"))


def hot_hosts(pages: DataFrame, url_col: str) -> DataFrame:
    """(host, salts) of hosts with more than ``ROWS_A_SALT`` rows and more than 1 / ``MAX_HOT`` of all rows: fewer than ``MAX_HOT`` hosts."""
    rows = pages.groupBy(host_of(F.col(f"`{url_col}`")).alias("host")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    limit = max(ROWS_A_SALT, total / MAX_HOT)
    return rows.where(F.col("n") > limit).select("host", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars."""
    hot = F.broadcast(hot_hosts(pages, url_col))  # fewer than MAX_HOT rows, see there
    salts = F.coalesce(F.col("salts"), F.lit(1))
    known = templates(pages, url_col, html_col).join(hot, "host", "left")
    known = known.select(F.col("host").alias("h"), "template", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    src = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
    )
    src = src.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("id", "url"), salts).cast("int"))
    src = src.join(known, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")

    def make():
        def run(html, template):
            texts = [main_text(x, frozenset(t or ())) if x else "" for x, t in zip(texts_of(html), template.to_pylist())]
            yield pa.array(texts, pa.string())
            yield pa.array([len(t) for t in texts], pa.int64())

        return run

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    out = annotate(src, ["html", "template"], fields, make, ["id", "url"], chunk_bytes=4 << 20)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(table(spark, sf_dir, "pages"))
