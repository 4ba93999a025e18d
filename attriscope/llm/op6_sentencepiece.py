"""SentencePiece models run by the tokenizers library, with a parity check.

The model's protobuf is read here (wire format, only the fields that matter) and rebuilt:
normaliser (character map, extra white space, dummy prefix), the metaspace
marker, the vocabulary with its scores (unigram: as they are; BPE: merges in
the order of the merged pieces' scores) and byte fallback.

No piece crosses from a visible character to a space marker or holds a line end (checked when
the model is read), so a text is encoded piecewise: runs of markers with the
visible characters after them.  Each distinct run is encoded once in a batch, by
``encode_batch_fast`` on the task's own thread; runs that a task has met are remembered, the last ``REMEMBER`` and those before.

Parity: the ids are the tokenizers backend's.  Every text is compared with the sentencepiece library: its normal form,
and the ids of each of its runs.  For a BPE model this is the comparison of the whole text, as the library joins
symbols only to pieces of the vocabulary and none crosses a run.  It is not where unknown symbols are fused (across
runs) or a unigram's score is summed over the text (rounding): such texts are encoded whole by the library as well,
every one.  Differences are counted in the row's ``n_parity``; none stops a job.

Decoding goes from ids to text by the tokenizers library's decoders (marker, byte
pieces).  Each distinct run is decoded again; round_trip says whether all runs of a
text, and so the whole normalised text, come back.

Edge cases: null, empty: no ids; texts of any length are encoded whole;
repeated rows get equal results; an empty table gives no row; unpaired
surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import array
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attriscope.llm.common import annotate, held, table, texts_of

MARK = "▁"
REMEMBER, GROUP = 300_000, 4_000
WHOLE = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(data: bytes):
    """(field, value) of a protobuf message: ints, 4- and 8-byte words and byte strings."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


class SentencePiece:
    """Encoder and decoder rebuilt from a SentencePiece ``.model`` file."""

    def __init__(self, path: str, parity: bool = True):
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            fields = list(wire(f.read()))
        self.pieces, self.scores, self.types = [], [], []
        for _, raw in (x for x in fields if x[0] == 1):
            p = dict(wire(raw))
            self.pieces.append(p[1].decode("utf-8"))
            self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            self.types.append(p.get(3, NORMAL))
        trainer = dict(wire(next((v for k, v in fields if k == 2), b"")))
        norm = dict(wire(next((v for k, v in fields if k == 3), b"")))
        self.kind = {1: "unigram", 2: "bpe"}[trainer.get(3, 1)]
        if trainer.get(24, 0) or norm.get(5, 1) == 0 or USER in self.types:
            raise ValueError("markers after words, unescaped white space and user-defined pieces are not supported")
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        charsmap = norm.get(2, b"")
        self.charsmap = normalizers.Precompiled(charsmap) if charsmap else None
        vocab = {p: i for i, p in enumerate(self.pieces)}
        unk = self.types.index(UNKNOWN)
        fallback = bool(trainer.get(35, 0))
        if self.kind == "unigram":
            model = models.Unigram([(p, s) for p, s in zip(self.pieces, self.scores)], unk_id=unk, byte_fallback=fallback)
        else:
            model = models.BPE(vocab=vocab, merges=self._merges(vocab), unk_token=self.pieces[unk], fuse_unk=True, byte_fallback=fallback)
        self.tok = Tokenizer(model)
        self.tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        plain = [p for p, t in zip(self.pieces, self.types) if t in (NORMAL, UNUSED)]  # what the library joins symbols to
        crossing = any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in plain)
        self.runs = None if crossing else re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
        self.unk = unk
        self.known: dict[str, bytes] = {}  # 32-bit ids of a run
        self.before: dict[str, bytes] = {}  # the runs remembered before those
        self.differ: set[str] = set()  # runs with other ids in sentencepiece
        self.lossy: set[str] = set()  # runs that do not decode to themselves
        self.lib = None
        if parity:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            # the same model without its own prefix and white-space rule, for runs that are normalised already
            proto = self.lib.serialized_model_proto()
            self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto + b"\x1a\x06\x18\x00\x20\x00\x28\x01")

    def _merges(self, vocab: dict[str, int]) -> list[tuple[str, str]]:
        """All ways to join two pieces to a piece, best score first, then by vocabulary order of the parts."""
        own = [(p, s) for p, s, t in zip(self.pieces, self.scores, self.types) if t == NORMAL]
        normal = {p for p, _ in own}
        out = []
        for p, s in own:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in normal and b in normal:
                    out.append((-s, vocab[a], vocab[b], a, b))
        out.sort()
        return [x[3:] for x in out]

    def normalise(self, text: str) -> str:
        """The text as the model sees it, with markers for spaces."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def split(self, text: str) -> list[str]:
        """The normalised text in runs that are encoded by themselves."""
        form = self.normalise(text)
        return self.runs.findall(form) if self.runs else [form] * bool(form)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; runs are compared with sentencepiece on the way."""
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.before, self.known = self.known, {}
        new = {r for c in cut for r in c}.difference(self.known)
        met = new & self.before.keys()
        self.known.update((r, self.before[r]) for r in met)
        new = list(new - met)
        for at in range(0, len(new), GROUP):
            self.learn(new[at : at + GROUP])
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), np.int32) for c in cut]
        return out

    def differences(self, texts: list[str], ids: list[np.ndarray]) -> list[int]:
        """Runs of each text with other ids in the sentencepiece library; 1 if only the text as a whole differs."""
        if not self.lib or not texts:
            return [0] * len(texts)
        same = [a == self.normalise(t) for a, t in zip(self.lib.normalize(texts), texts)]
        by_runs = self.kind == "bpe" and self.runs is not None
        whole = [i for i, x in enumerate(ids) if same[i] and not (by_runs and (x != self.unk).all())]
        for i, theirs in zip(whole, self.lib.encode([texts[i] for i in whole], num_threads=1) if whole else []):
            same[i] = ids[i].tolist() == theirs
        runs = [sum(r in self.differ for r in self.split(t)) if self.differ else 0 for t in texts]
        return [max(n, int(not s)) for n, s in zip(runs, same)]

    def whole_differs(self, text: str, ids: np.ndarray) -> bool:
        """A spot check by hand (one text in ``WHOLE``); no result comes from it, :meth:`differences` asks every text."""
        if not self.lib or zlib.crc32(text.encode("utf-8", "surrogatepass")) % WHOLE:
            return False
        return ids.tolist() != self.lib.encode(text)

    def learn(self, new: list[str]) -> None:
        """Encode runs that were not met before, compare them with sentencepiece and decode them again."""
        ids = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        if self.lib:
            theirs = self.bare.encode([r.replace(MARK, " ") for r in new], num_threads=1)
            self.differ.update(r for r, a, b in zip(new, ids, theirs) if a != b)
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        self.lossy.update(r for r, t in zip(new, back) if t != r.replace(MARK, " "))
        self.known.update((r, array.array("i", x).tobytes()) for r, x in zip(new, ids))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        texts = self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]

    def plain(self, text: str) -> str:
        """What decoding the text's ids has to give, where nothing is unknown."""
        t = self.normalise(text).replace(MARK, " ")
        return t[1:] if self.prefix and t.startswith(" ") else t


def loaded(path: str, parity: bool) -> SentencePiece:
    """The model, read once in a worker; the runs it has met stay known to the worker's next tasks, until one of another kind."""
    return held(("sentencepiece", path, parity), lambda: SentencePiece(path, parity))


def tokenize(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, parity: bool = True) -> DataFrame:
    """Columns ``keep`` (default all) with ids, n_pieces, n_parity (runs, or the whole text, with other ids in sentencepiece) and round_trip."""
    keep = docs.columns if keep is None else keep

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task's share of a machine is one core
        sp = loaded(model_path, parity)

        def run(text):
            texts = texts_of(text)
            ids = sp.encode(texts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.array(size, pa.int64())
            yield pa.array(sp.differences(texts, ids), pa.int64())
            yield pa.array([not sp.lossy or sp.lossy.isdisjoint(sp.split(t)) for t in texts], pa.bool_())

        return run

    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("n_parity", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    return annotate(docs, [text_col], fields, make, keep, chunk_bytes=2 << 20, holds=True)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents with piece_bpe_32k.model."""
    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
