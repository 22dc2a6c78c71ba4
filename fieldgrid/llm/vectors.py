"""What the vector operators share: Arrow list columns as matrices, exact integer products, stored rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..session import Stored

EXACT = 2**53  # integers up to here are exact in doubles, and so are sums that stay below


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix of doubles)`` for each length that occurs; vectors that are null or hold a null or non-finite
    component are left out."""
    if not len(column):
        return
    column = column.cast(pa.large_list(pa.float64()))
    x = pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False)
    edge = column.offsets.to_numpy()
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (odd[edge[1:]] == odd[edge[:-1]])
    length = np.diff(edge)
    for n in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == n))
        yield rows, x[edge[rows][:, None] + np.arange(n)]


def quantised(x: np.ndarray, scale: float, square: float) -> np.ndarray:
    """``floor(scale * x)`` as integers.

    ``square`` times the number of components times the largest square must stay in 63 bits, so that sums of products
    do; larger components raise.
    """
    q = np.floor(scale * x)
    if q.size and square * q.shape[1] * float(np.abs(q).max()) ** 2 >= 2.0**62:
        raise ValueError(f"components beyond {np.sqrt(2.0**62 / square / q.shape[1]) / scale:.3g} do not fit 64-bit products")
    return q.astype(np.int64)


def pack_integers(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes per number (2, 4 or 8) and the numbers in that width."""
    most = int(np.abs(values).max()) if values.size else 0
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, values.astype(f"<i{width}").tobytes()


def unpack_integers(width: int, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims) if dims else np.zeros((0, 0), np.int64)


__all__ = ["EXACT", "Stored", "finite_vectors", "pack_integers", "quantised", "unpack_integers"]
