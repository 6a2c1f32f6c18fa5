"""Texts as numpy arrays: code points, words and their hashes for a whole batch at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The lowest 0 to 8 bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans of bytes are hashed by prefix sums, in steps whose number does not follow their length.
_LONG = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _MULTIPLIER))), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _INVERSE))), dtype=np.uint64)
    return _powers, _inverses


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix, from the empty one; see :func:`span_hashes`."""
    powers, _ = _tables(len(points) + 1)
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points; equal spans have equal hashes wherever they stand."""
    _, inverses = _tables(len(prefixes))
    return mix64((prefixes[ends] - prefixes[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that hold no ASCII white space."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def word_hashes(points: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(points)
    return span_hashes(prefix_sums(points), starts, ends)


def begins(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Distinct numbers in rising order.  Hashing them first, as np.unique does, takes far longer where most differ."""
    ordered = np.sort(numbers)
    return ordered[begins(ordered)]


def numbered(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in rising order, and the place there of each of ``numbers``."""
    order = np.argsort(numbers)
    ordered = numbers[order]
    new = begins(ordered)
    places = np.empty(len(numbers), np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], places


def byte_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text.

    UTF-8 needs no decoding for that: letters and blanks of ASCII stand in no other character.
    """
    size = sum(map(len, texts)) + len(texts)
    data = np.frombuffer(b"\n".join([*texts, bytes(16 + -size % 8)]), np.uint8)
    data = data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    blank = (data[:size] == 32) | (data[:size] - np.uint8(9) <= 4)
    edges = np.append(-1, np.flatnonzero(blank))
    some = np.flatnonzero(np.diff(edges) > 1)
    starts, ends = edges[some] + 1, edges[some + 1]
    borders = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return byte_hashes(data, starts, ends), np.diff(np.searchsorted(starts, borders), prepend=0)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; equal spans have equal hashes wherever they stand.

    Spans are read eight bytes at a time, long ones by prefix sums.  ``data`` is some multiple of 8 bytes and goes on for
    8 bytes behind the last span.
    """
    eights, sizes = data.view("<u8"), ends - starts

    def read(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        shift, slot = (at & 7).astype(np.uint64) << np.uint64(3), at >> 3
        found = eights[slot] >> shift | eights[slot + 1] << np.uint64(1) << np.uint64(63) - shift
        return found & _MASKS[np.minimum(left, 8)]

    out = mix64(read(starts, sizes) ^ sizes.astype(np.uint64) * _MULTIPLIER)
    rest = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    for done in range(8, _LONG, 8):
        out[rest] = mix64(out[rest] ^ read(starts[rest] + done, sizes[rest] - done))
        rest = rest[sizes[rest] > done + 8]
    far = np.flatnonzero(sizes > _LONG)
    if len(far):
        to = np.cumsum(sizes[far])
        at = np.arange(to[-1]) + np.repeat(ends[far] - to, sizes[far])
        out[far] = span_hashes(prefix_sums(data[at]), to - sizes[far], to)
    return out
