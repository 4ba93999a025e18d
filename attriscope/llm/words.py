"""Words of a batch of texts as numpy arrays: positions, documents and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text, in order.

    data: UTF-8 bytes of all texts, each followed by one space;
    start, end: a word's bytes; doc: its text; first: words before each text (one entry more than texts).
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.ends = np.cumsum(lengths) if len(raw) else np.zeros(0, np.int64)  # past each text's space
        self.space = _SPACE[self.data]
        edge = np.diff(np.concatenate([[True], self.space, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.concatenate([[0], np.searchsorted(self.start, self.ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each word (polynomial over its bytes; ``fold_case``: A-Z as a-z)."""
        d = self.data
        if fold_case:
            d = np.where((d >= 65) & (d <= 90), d + np.uint8(32), d)
        n = len(d)
        with np.errstate(over="ignore"):
            sums = np.cumsum((d.astype(np.uint64) + np.uint64(1)) * _powers("inv", _INV, n))
            before = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
            return mix64((sums[self.end - 1] - before) * _powers("m", _M, n + 1)[self.end])

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``width`` words within a text."""
        n = len(self)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        with np.errstate(over="ignore"):
            out = np.zeros(len(at), np.uint64)
            for k in range(width):
                out = mix64(out * _M + hashes[at + k])
        return at, out


def per_text(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text."""
    return np.bincount(docs, weights=values, minlength=n)


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(a, np.int64), pa.int64())
