"""Arrays of whole numbers as short byte strings, for binary columns."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)
_HEAD = struct.Struct("<IB")


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0, bytes of equal weight side by side; high bytes that are 0 everywhere are left out."""
    wide = (int(numbers.max()).bit_length() + 7) // 8 if len(numbers) else 0
    numbers = numbers.astype(np.uint64, copy=False)
    planes = np.empty((wide, len(numbers)), np.uint8)
    for i in range(wide):
        planes[i] = (numbers >> np.uint64(8 * i)).astype(np.uint8)
    return _HEAD.pack(len(numbers), wide) + (_CODEC.compress(planes.tobytes(), asbytes=True) if wide else b"")


def unpack(packed: bytes) -> np.ndarray:
    n, wide = _HEAD.unpack_from(packed)
    out = np.zeros(n, np.uint64)
    if wide:
        planes = np.frombuffer(_CODEC.decompress(packed[_HEAD.size :], n * wide), np.uint8).reshape(wide, n)
        for i in range(wide):
            out |= planes[i].astype(np.uint64) << np.uint64(8 * i)
    return out.view(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """64-bit numbers in rising order, as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed).view(np.uint64), dtype=np.uint64)
