"""One consistent form for text that looks the same.

Each text is exploded to positioned code points; decomposition and look-alike
mappings are broadcast tables gathered by code point; combining marks are put in the
order of their classes, recomposed, and the strings rebuilt. The exploded rows live
only inside an Arrow batch: a text never leaves its partition, so there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import spread
from .codepoints import LIMIT, chunked, explode, rebuild, slots

#: What was found in a text; ``kinds`` is the sum.
COMPATIBILITY, SEPARATE_MARK, INVISIBLE, SPACE, LOOK_ALIKE = 1, 2, 4, 8, 16

# Letters of other scripts and the Latin letters they resemble; a selection from the
# confusable characters of Unicode Technical Standard 39 that have the same shape in common fonts.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Һ": "H",
    # Greek
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C",
    "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F",
    "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

# Invisible characters that are not of the format category.
INVISIBLE_RANGES = (
    (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0x2800, 0x2800),
)

_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
_NEEDS_LOOK, _DECOMPOSES, _SECOND, _LATIN, _FOREIGN, _IN_WORD = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class FormTables:
    """Character tables, indexed by code point."""

    flags: np.ndarray
    kind: np.ndarray
    mark_class: np.ndarray
    expand_at: np.ndarray
    expand_len: np.ndarray
    expansions: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray
    alike: np.ndarray


def _invisible(ch: str, c: int) -> bool:
    category = unicodedata.category(ch)
    if category == "Cf" or (category == "Cc" and ch not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f"):
        return True
    return any(a <= c <= b for a, b in INVISIBLE_RANGES)


@lru_cache(maxsize=1)
def form_tables() -> FormTables:
    """Built from the standard library's Unicode data.

    A spacing accent (a compatibility form of a blank with a mark) is a sign in its own
    right and stays. Line and paragraph separators stay as they are.
    """
    size = LIMIT + 2
    flags = np.zeros(size, np.uint8)
    kind = np.zeros(size, np.uint8)
    mark_class = np.zeros(size, np.uint8)
    expand_at = np.zeros(size, np.int32)
    expand_len = np.zeros(size, np.int32)
    alike = np.zeros(size, np.uint32)
    expansions: list[int] = []
    pairs: dict[int, int] = {}
    for c in range(0x20, LIMIT):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        if category == "Cn":
            continue
        f = k = 0
        if category[0] == "L":
            f |= _IN_WORD | (_LATIN if c < 0x80 or unicodedata.name(ch, "").startswith("LATIN") else _FOREIGN)
        elif category[0] == "M":
            f |= _IN_WORD
        mark_class[c] = unicodedata.combining(ch)
        full = unicodedata.normalize("NFKD", ch)
        if _invisible(ch, c):
            k, f, full = INVISIBLE, f | _NEEDS_LOOK, ch
        elif category == "Zs" and c != 0x20:
            k, f, full = SPACE, f | _NEEDS_LOOK | _DECOMPOSES, " "
        elif len(full) > 1 and full[0] == " " and unicodedata.combining(full[1]):
            full = ch
        elif full != ch:
            raw = unicodedata.decomposition(ch)
            if unicodedata.normalize("NFKC", ch) != ch:
                f |= _NEEDS_LOOK | _DECOMPOSES
                k = COMPATIBILITY if unicodedata.normalize("NFC", ch) != unicodedata.normalize("NFKC", ch) else 0
            if raw and not raw.startswith("<") and " " in raw and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in raw.split())
                pairs[a << 32 | b] = c
        if full != ch:
            expand_at[c], expand_len[c] = len(expansions), len(full)
            expansions.extend(map(ord, full))
        if mark_class[c]:
            f |= _NEEDS_LOOK
        flags[c], kind[c] = f, k
    for s in range(11172):  # Hangul syllables compose by rule
        lead, vowel, tail = 0x1100 + s // 588, 0x1161 + s % 588 // 28, s % 28
        if tail:
            pairs[(0xAC00 + s - tail) << 32 | (0x11A7 + tail)] = 0xAC00 + s
        else:
            pairs[lead << 32 | vowel] = 0xAC00 + s
    for c in [*range(0x00, 0x20), 0x7F]:
        if _invisible(chr(c), c):
            flags[c], kind[c] = _NEEDS_LOOK, INVISIBLE
    flags[LIMIT + 1], kind[LIMIT + 1] = _NEEDS_LOOK, INVISIBLE
    for second in {p & 0xFFFFFFFF for p in pairs}:
        flags[second] |= _SECOND | _NEEDS_LOOK
    for foreign, latin in LOOK_ALIKES.items():
        alike[ord(foreign)] = ord(latin)
        flags[ord(foreign)] |= _NEEDS_LOOK
    keys = np.array(sorted(pairs), np.uint64)
    return FormTables(flags, kind, mark_class, expand_at, expand_len, np.array(expansions, np.uint32), keys, np.array([pairs[int(k)] for k in keys], np.uint32), alike)


def _look_up(first: np.ndarray, second: np.ndarray, t: FormTables) -> np.ndarray:
    """The composed character of each pair, 0 where there is none."""
    key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    at = np.minimum(np.searchsorted(t.pairs, key), t.pairs.size - 1)
    return np.where(t.pairs[at] == key, t.composed[at], 0).astype(np.uint32)


def _expand(cps, doc, apart, t, flags):
    """Decompose what is not canonical by itself, and composed letters before a mark."""
    at = slots(cps)
    length = t.expand_len[at]
    need = (flags & _DECOMPOSES) > 0
    if cps.size > 1:
        need[:-1] |= (length[:-1] > 0) & (t.mark_class[at[1:]] > 0) & (doc[1:] == doc[:-1])
    if not need.any():
        return cps, doc, apart
    copies = np.where(need, length, 1)
    ends = np.cumsum(copies)
    out, out_doc, out_apart = np.repeat(cps, copies), np.repeat(doc, copies), np.repeat(apart, copies)
    n = copies[need]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    target = np.repeat(ends[need] - n, n) + within
    out[target] = t.expansions[np.repeat(t.expand_at[at[need]], n) + within]
    out_apart[target] = np.repeat(apart[need], n)
    return out, out_doc, out_apart


def _latinize(cps, doc, kinds, t):
    """Replace look-alikes in words that hold a Latin letter or only letters that could pass for Latin."""
    at = slots(cps)
    alike = t.alike[at]
    if not alike.any():
        return cps
    f = t.flags[at]
    inside = (f & _IN_WORD) > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    word = np.cumsum(starts)
    n = int(word[-1]) + 1
    latin = np.zeros(n, bool)
    latin[word[(f & _LATIN) > 0]] = True
    other = np.zeros(n, bool)
    other[word[((f & _FOREIGN) > 0) & (alike == 0)]] = True
    swap = (alike > 0) & (latin[word] | ~other[word])
    np.bitwise_or.at(kinds, doc[swap], LOOK_ALIKE)
    return np.where(swap, alike, cps)


def _compose(cps, doc, apart, kinds, t):
    """Order marks by class, then compose them with their letters."""
    at = slots(cps)
    marks = t.mark_class[at]
    first = np.ones(cps.size, bool)
    first[1:] = doc[1:] != doc[:-1]
    if ((marks[1:] > 0) & (marks[:-1] > marks[1:]) & ~first[1:]).any():
        order = np.lexsort((marks, np.cumsum((marks == 0) | first)))
        cps, apart, marks = cps[order], apart[order], marks[order]
    while True:
        at = slots(cps)
        second = np.flatnonzero((t.flags[at] & _SECOND) > 0)
        second = second[second > 0]
        second = second[(doc[second] == doc[second - 1]) & (marks[second - 1] == 0)]
        to = _look_up(cps[second - 1], cps[second], t)
        second, to = second[to > 0], to[to > 0]
        chained = np.isin(second - 1, second)
        second, to = second[~chained], to[~chained]
        base = second - 1
        if not second.size:
            second, base, to = _compose_apart(cps, doc, marks, t)
            if not second.size:
                return cps, doc, apart
        separate = second[apart[second]]
        np.bitwise_or.at(kinds, doc[separate], SEPARATE_MARK)
        cps = cps.copy()
        cps[base] = to
        keep = np.ones(cps.size, bool)
        keep[second] = False
        cps, doc, apart, marks = cps[keep], doc[keep], apart[keep], marks[keep]


def _compose_apart(cps, doc, marks, t):
    """A mark that composes past another one of a lower class; one for each letter at a time. Such text is rare."""
    hits = {}
    for i in np.flatnonzero((marks[1:] > marks[:-1]) & (marks[:-1] > 0) & (doc[1:] == doc[:-1])) + 1:
        s = i - 1
        while s > 0 and marks[s] > 0 and doc[s - 1] == doc[i]:
            s -= 1
        if marks[s] == 0 and s not in hits:
            to = _look_up(cps[s : s + 1], cps[i : i + 1], t)[0]
            if to:
                hits[s] = (i, to)
    base = np.array(sorted(hits), np.int64)
    return np.array([hits[s][0] for s in base], np.int64), base, np.array([hits[s][1] for s in base], np.uint32)


def canonical_chunk(cps: np.ndarray, starts: np.ndarray, t: FormTables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical code points, their offsets, and the kinds found in each text."""
    kinds = np.zeros(starts.size - 1, np.uint8)
    at = slots(cps)
    flags = t.flags[at]
    if not (flags & _NEEDS_LOOK).any():
        return cps, starts, kinds
    doc = np.repeat(np.arange(starts.size - 1, dtype=np.int32), np.diff(starts))
    kind = t.kind[at]
    odd = np.flatnonzero(kind)
    np.bitwise_or.at(kinds, doc[odd], kind[odd])
    apart = t.mark_class[at] > 0
    seen = kind != INVISIBLE
    if not seen.all():
        cps, doc, apart, flags = cps[seen], doc[seen], apart[seen], flags[seen]
    cps, doc, apart = _expand(cps, doc, apart, t, flags)
    # composed first, so that a letter of another script is judged with its accent
    cps, doc, apart = _compose(cps, doc, apart, kinds, t)
    latin = _latinize(cps, doc, kinds, t)
    if latin is not cps:
        cps, doc, apart = _compose(latin, doc, apart, kinds, t)
    out = np.zeros(starts.size, np.int64)
    np.cumsum(np.bincount(doc, minlength=starts.size - 1), out=out[1:])
    return cps, out, kinds


def canonical_texts(texts: list[str | None], t: FormTables | None = None) -> tuple[list[str | None], list[int]]:
    """The canonical form of each text and the kinds found in it; null stays null.

    Plain ASCII without control characters is canonical already and is not exploded; nor is a
    text without a character that calls for a look taken further.
    """
    t = t or form_tables()
    out, found = list(texts), [0] * len(texts)
    todo = [i for i, x in enumerate(texts) if x and (not x.isascii() or _CONTROL.search(x))]
    for lo, hi in chunked([texts[i] for i in todo]):
        cps, starts = explode([texts[i] for i in todo[lo:hi]])
        look = np.zeros(cps.size + 1, np.int64)
        np.cumsum((t.flags[slots(cps)] & _NEEDS_LOOK) > 0, out=look[1:])
        part = np.flatnonzero(look[starts[1:]] > look[starts[:-1]])
        if part.size < hi - lo:
            inside = np.zeros(hi - lo, bool)
            inside[part] = True
            length = np.diff(starts)
            cps, starts = cps[np.repeat(inside, length)], np.append(0, np.cumsum(length[part]))
        cps, starts, kinds = canonical_chunk(cps, starts, t)
        for i, new, k in zip(part.tolist(), rebuild(cps, starts), kinds.tolist()):
            out[todo[lo + i]], found[todo[lo + i]] = new, k
    return out, found


def canonical_form(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the canonical ``text`` and ``kinds``, a bit for each kind of difference found.

    One row for each input row, so repeated rows and repeated keys stay. A null text stays
    null and an empty one empty, with kinds 0; other columns are left out, so their names
    cannot clash. There is no shuffle and texts of any length are taken whole.
    """
    tables = df.sparkSession.sparkContext.broadcast(form_tables())
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("text", T.StringType()), T.StructField("kinds", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = canonical_texts(b.column(1).to_pylist(), tables.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.int32())], ["key", "text", "kinds"])

    out = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))).mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), F.col("text"), F.col("kinds"))
