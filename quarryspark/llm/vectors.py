"""Vectors in Arrow batches: checked, as bytes, and back as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column's components as doubles, the offsets of its rows, and which rows are whole: not null, all components finite."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
    whole = good[offsets[1:]] - good[offsets[:-1]] == np.diff(offsets)
    return flat, offsets, whole & column.is_valid().to_numpy(zero_copy_only=False)


def matrix(rows: list[bytes] | bytes, dims: int, kind: str) -> np.ndarray:
    data = rows if isinstance(rows, bytes) else b"".join(rows)
    n = len(rows) if isinstance(rows, list) else None
    flat = np.frombuffer(data, kind)
    return flat.reshape(n if n is not None else -1 if dims else 0, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b: whole numbers of 8 bytes, or of any size (object arrays)."""
    if object in (a.dtype, b.dtype):
        return a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
