"""Vector columns in Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Vectors:
    """The lists of an Arrow list column as doubles: ``values[start[i] : start[i] + length[i]]`` is row i.

    ``finite``: the row is not null, has a component, and each component is neither null nor non-finite.
    """

    def __init__(self, array: pa.Array):
        array = array.cast(pa.list_(pa.float64()))
        at = array.offsets.to_numpy().astype(np.int64)
        self.values = pc.fill_null(array.values, float("nan")).to_numpy(zero_copy_only=False)
        self.start, self.length = at[:-1], np.diff(at)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(self.values))])
        self.finite = array.is_valid().to_numpy(zero_copy_only=False) & (self.length > 0) & (bad[at[1:]] == bad[at[:-1]])

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """The rows (of one length) as a matrix."""
        if not len(rows):
            return np.zeros((0, 0))
        return self.values[self.start[rows][:, None] + np.arange(self.length[rows[0]])]


def unpack(raw: pa.Array, dim: int) -> np.ndarray:
    """Matrix of vectors that are stored as little-endian doubles."""
    parts = raw.to_pylist()
    return np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), dim)
