"""Texts as flat arrays of code points.

A chunk of texts is exploded into one ``uint32`` array of code points plus the offset
of each text, so that per-character work is a handful of array operations on whole
chunks, inside Arrow batches, and nothing exploded ever crosses a shuffle. All
per-character properties are gathers from tables indexed by code point, built once on
the driver from the Unicode data of the standard library and broadcast; their size is
bounded by Unicode itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Code points beyond this carry no decomposition; two more slots: "other" and "tags".
LIMIT = 0x30000
CHUNK_CHARS = 500_000
#: Matches a text that isn't blank, in Java's dialect and DuckDB's.
VISIBLE = r"[^\s\p{Z}]"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class CharTables:
    lower: np.ndarray
    word: np.ndarray


@lru_cache(maxsize=1)
def char_tables() -> CharTables:
    """Lower-case mapping and the letter-or-digit test for each code point."""
    lower = np.arange(LIMIT + 2, dtype=np.uint32)
    word = np.zeros(LIMIT + 2, dtype=bool)
    for c in range(LIMIT):
        ch = chr(c)
        if ch.isalnum():
            word[c] = True
            low = ch.lower()
            lower[c] = ord(low[0])
    word[LIMIT] = True  # the planes beyond hold ideographs
    return CharTables(lower, word)


def slots(cps: np.ndarray) -> np.ndarray:
    """Index of each code point in the tables."""
    if cps.size and cps.max() >= LIMIT:
        out = cps.copy()
        out[cps >= LIMIT] = LIMIT
        out[(cps >= 0xE0000) & (cps < 0xE1000)] = LIMIT + 1
        return out
    return cps


def chunked(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``limit`` characters, or one longer text."""
    lo = used = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and used + n > limit:
            yield lo, i
            lo, used = i, 0
        used += n
    if lo < len(texts):
        yield lo, len(texts)


def explode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and ``len(texts) + 1`` offsets; a null is empty."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=starts[1:])
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def rebuild(cps: np.ndarray, starts: np.ndarray) -> list[str]:
    """The strings behind exploded code points."""
    joined = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of a chunk: 64-bit hash, first and past-last character, and per-text offsets."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    starts: np.ndarray


def words_of(cps: np.ndarray, starts: np.ndarray, tables: CharTables) -> Words:
    """Runs of letters and digits in lower case, hashed."""
    at = slots(cps)
    inside = tables.word[at]
    edge = np.zeros(cps.size + 1, dtype=bool)
    edge[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    first = np.flatnonzero(opens)
    if not first.size:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(starts.size, dtype=np.int64))
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    last = np.flatnonzero(closes) + 1
    length = last - first
    chars = np.flatnonzero(inside)
    begins = np.cumsum(length) - length
    within = np.arange(chars.size) - np.repeat(begins, length)
    powers = np.full(int(length.max()), np.uint64(0x100000001B3), dtype=np.uint64)
    powers[0] = np.uint64(1)
    powers = np.cumprod(powers, dtype=np.uint64)
    values = (tables.lower[at[chars]].astype(np.uint64) + np.uint64(1)) * _GOLD
    values ^= values >> np.uint64(32)
    hashes = mix(np.add.reduceat(values * powers[within], begins))
    return Words(hashes, first, last, np.searchsorted(first, starts))


def grams_of(words: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and per-text offsets.

    With ``short`` the only run of a text of fewer words is the whole of it.
    """
    size = np.diff(words.starts)
    counts = np.maximum(size - (k - 1), (size > 0) if short else 0).astype(np.int64)
    starts = np.zeros(counts.size + 1, dtype=np.int64)
    np.cumsum(counts, out=starts[1:])
    if not starts[-1]:
        return np.zeros(0, dtype=np.uint64), starts
    at = np.arange(starts[-1]) + np.repeat(words.starts[:-1] - starts[:-1], counts)
    h = words.hashes[at]
    width = np.repeat(np.minimum(size, k), counts) if short else None
    for j in range(1, k):
        if short:
            more = width > j
            h[more] = mix(h[more] * _GOLD + words.hashes[at[more] + j])
        else:
            h = mix(h * _GOLD + words.hashes[at + j])
    return h, starts
