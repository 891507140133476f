"""Integer arrays as compact binary cells."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the mostly empty high ones compress to nothing."""
    width = values.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(cell, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(cell, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def ascending(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, as differences."""
    out = values.copy()
    out[1:] -= values[:-1]
    return planes(out)


def unascending(cell, dtype) -> np.ndarray:
    return np.cumsum(unplaned(cell, dtype), dtype=dtype)
