"""Arrays of numbers as short byte strings, for tables that hold many numbers in a row."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import zstandard


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Integers or doubles, compressed; ``rising`` (sorted integers) keeps differences."""
    x = np.ascontiguousarray(x)
    if x.dtype.kind == "f":
        kind, x = b"d", x.astype(np.float64)
    else:
        kind = b"r" if rising else b"i"
        if rising and len(x):
            x = np.diff(x, prepend=x.dtype.type(0))
        top = int(x.max()) if len(x) else 0
        x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    # Bytes of the same rank stand together: those that are alike compress well.
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return kind + bytes([x.itemsize]) + zstandard.compress(planes, 1)


def unpack(blob: bytes) -> np.ndarray:
    """int64, or float64 for doubles."""
    kind, width = blob[:1], blob[1]
    planes = np.frombuffer(zstandard.decompress(blob[2:]), np.uint8)
    n = len(planes) // width
    raw = np.ascontiguousarray(planes.reshape(width, n).T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64 if kind == b"d" else np.uint64}[width]).reshape(n)
    if kind == b"d":
        return raw
    x = raw.view(np.int64) if width == 8 else raw.astype(np.int64)
    return np.cumsum(x) if kind == b"r" else x


def give_back() -> None:
    """Return freed memory to the system: a reused Python worker else keeps what its earlier stages needed at most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
