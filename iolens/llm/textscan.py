"""Vectorised scanning of whole texts: character classes, runs and their hashes.

A block of texts is one array of code points, each text followed by a
separator, so that one pass of numpy covers all of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

LETTER, NUMBER, SPACE, OTHER, GONE, END = range(6)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Invisible characters that split words without being seen.
INVISIBLE = [0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
#: Marks the end of a text; no code point has this value.
STOP = 0x110000
#: Code points from here on are private, unassigned or tags.
LAST = 0x34000
#: Characters per block, unless one text alone is longer.
BLOCK = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

_tables: dict[bool, np.ndarray] = {}


def classes(drop_invisible: bool = False) -> np.ndarray:
    """The class of every code point; with drop_invisible the invisible ones are GONE."""
    if drop_invisible not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.full(STOP + 1, OTHER, np.uint8)  # no letters or numbers lie beyond LAST
        out[:LAST] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LAST)), np.uint8, LAST)
        out[STOP] = END
        out[WHITE_SPACE] = SPACE
        if drop_invisible:
            out[INVISIBLE] = GONE
        _tables[drop_invisible] = out
    return _tables[drop_invisible]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of consecutive blocks; null counts as empty."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > BLOCK:
            yield at, held
            at, size, held = i, 0, []
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, STOP after each, and the position of each text's STOP."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths + 1) - 1
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[stops] = STOP
    return points, stops


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch points[start:end], from one pass over all points."""
    n = len(points)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= power[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    inverse = np.full(n + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    kept = counts > 0
    starts, counts = starts[kept], counts[kept]
    if not len(starts):
        return np.empty(0, np.int64)
    out[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    out[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)
