"""Evaluation passages inside training text, found by winnowing.

Every run of ``k`` words is hashed, and the least hash of each window of
``span - k + 1`` runs is kept. Two texts that share ``span`` words in a row share a whole
window, hence its fingerprint, so no such passage is missed. Fingerprints of both sides
are joined, and each hit is extended word by word to its full length.

Where the least hash comes several times in a window, as in repetitive text, a training text
keeps one place for as many windows as it lies in, and a test item keeps them all: the
places that correspond are then among the pairs, and repetitive text has few fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import durable, spread
from ..operators.skew import fragment_replicate_join
from .canonical import FormTables, canonical_texts, form_tables
from .codepoints import char_tables, chunked, explode, grams_of, words_of

#: Rows, and characters of text, of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_CHARS = 1_000_000, 32_000_000


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, its ``text`` too."""
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0)) if text else F.lit(0)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


def _uneven(left: DataFrame, right: DataFrame, key: str, name: str, text: str | None = None) -> DataFrame:
    """Join where some keys of ``left`` may be frequent: ``right`` is broadcast if counted small, else ``left`` is placed by load."""
    counted = small(right, text)
    if counted is not right:
        return left.join(counted, key)
    return fragment_replicate_join(durable(left, name), right, key, ["d"]).drop("_task")


def _last_least(grams: np.ndarray, window: int) -> np.ndarray:
    """Position of the last of the least hashes of each window, from windows of half the size."""
    at, size = np.arange(grams.size), 1
    while size < window:
        step = min(size, window - size)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] <= grams[left], right, left)
        size += step
    return at


def _selected(grams: np.ndarray, starts: np.ndarray, window: int, every: bool = False) -> np.ndarray:
    """Positions of the least hash of each window inside one text.

    Of several in a window, ``every`` one is taken; otherwise the last one, unless the one taken
    before still lies in the window.
    """
    if grams.size < window:
        return np.zeros(0, np.int64)
    counts = np.maximum(np.diff(starts) - (window - 1), 0)
    first = np.arange(counts.sum()) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    chosen = np.zeros(grams.size, bool)
    if not first.size:
        return np.flatnonzero(chosen)
    last = _last_least(grams, window)[first]
    least = grams[last]
    if every:
        row, place = np.nonzero(np.lib.stride_tricks.sliding_window_view(grams, window)[first] == least[:, None])
        chosen[first[row] + place] = True
        return np.flatnonzero(chosen)
    # neighbouring windows of one least value: one place for all, or from one to the next
    opens = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)))
    ends = np.append(opens[1:], first.size) - 1
    single = last[opens] == last[ends]
    chosen[last[opens[single]]] = True
    for i, end in zip(opens[~single].tolist(), ends[~single].tolist()):
        while i <= end:
            chosen[last[i]] = True
            i += int(last[i] - first[i]) + 1
    return np.flatnonzero(chosen)


def fingerprints(df: DataFrame, key: str, text: str, k: int, span: int, every: bool = False, unified: bool = True) -> DataFrame:
    """``key``, ``print`` and the word positions ``at`` of each winnowed fingerprint of a row."""
    context = df.sparkSession.sparkContext
    tables = context.broadcast((form_tables() if unified else None, char_tables()))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("print", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, chars = tables.value
        for b in batches:
            texts = _read(b.column(1).to_pylist(), forms)
            for lo, hi in chunked(texts):
                grams, starts = grams_of(words_of(*explode(texts[lo:hi]), chars), k)
                at = _selected(grams, starts, span - k + 1, every)
                doc = np.searchsorted(starts, at, "right") - 1
                order = np.lexsort((at, grams[at], doc))
                at, doc = at[order], doc[order]
                value = grams[at].view(np.int64)
                new = np.ones(at.size, bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, at.size).astype(np.int32)), pa.array((at - starts[doc]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[first] + lo)), pa.array(value[first]), places], ["key", "print", "at"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")).mapInArrow(run, schema)


def _read(texts: list[str | None], forms: FormTables | None) -> list[str | None]:
    return texts if forms is None else canonical_texts(texts, forms)[0]


def _shifts(places: list[dict]) -> np.ndarray:
    """Distinct distances between the places of common fingerprints in both texts, ascending."""
    low = min(int(p["doc_at"][0]) - int(p["item_at"][-1]) for p in places)
    high = max(int(p["doc_at"][-1]) - int(p["item_at"][0]) for p in places)
    seen = np.zeros(high - low + 1, bool)
    for p in places:
        few, many = sorted((np.array(p["doc_at"], np.int64), -np.array(p["item_at"], np.int64)), key=len)
        for x in few.tolist():
            seen[many + (x - low)] = True
    return np.flatnonzero(seen) + low


def _longest(doc: np.ndarray, item: np.ndarray, shifts: Iterable[int]) -> tuple[int, int, int]:
    """Length of the longest shared run on the given diagonals, and where it begins in each; the first of equal ones."""
    best = (0, 0, 0)
    for shift in sorted(shifts):
        if best[0] == item.size:
            break
        lo = max(0, shift)
        hi = min(doc.size, item.size + shift)
        if hi - lo <= best[0]:
            continue
        differs = np.flatnonzero(np.concatenate(([True], doc[lo:hi] != item[lo - shift : hi - shift], [True])))
        gaps = np.diff(differs) - 1
        i = int(gaps.argmax())
        if gaps[i] > best[0]:
            best = (int(gaps[i]), lo + int(differs[i]), lo + int(differs[i]) - shift)
    return best


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = 5, span: int = 13, unified: bool = True) -> DataFrame:
    """One row for each document and item that share at least ``span`` words in a row.

    Columns: ``doc_key``, ``item_key``, ``words`` (length of the longest shared run),
    ``doc_word`` and ``item_word`` (where it begins). Words are runs of letters and digits
    of the canonical text in lower case, or of the text as it is unless ``unified``. Null, empty and shorter texts leak nothing;
    repeated passages are all reported; a key on several rows gets its longest run; null
    keys are left out. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_key).alias("d"), F.col(text).cast("string").alias("doc_text")).where("d is not null")
    items = items.select(F.col(item_key).alias("i"), F.col(text).cast("string").alias("item_text")).where("i is not null")
    test = durable(fingerprints(items, "i", "item_text", k, span, True, unified).selectExpr("key as i", "print", "at as item_at"), "test-prints")
    train = fingerprints(docs, "d", "doc_text", k, span, False, unified).selectExpr("key as d", "print", "at as doc_at")
    found = _uneven(train, test, "print", "train-prints")
    # fingerprints that one document and item share are bounded by their lengths
    hits = found.groupBy("d", "i").agg(F.collect_list(F.struct("doc_at", "item_at")).alias("places"))
    hits = durable(hits, "hits")
    texts = docs.join(small(hits.select("d").distinct()), "d", "left_semi")
    pairs = _uneven(hits.hint("merge").join(texts, "d"), items, "i", "pairs", "item_text")
    context = docs.sparkSession.sparkContext
    tables = context.broadcast((form_tables() if unified else None, char_tables()))
    schema = T.StructType([T.StructField("d", docs.schema["d"].dataType), T.StructField("i", items.schema["i"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("words", "doc_word", "item_word"))])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, chars = tables.value

        def hashes(texts: list[str | None]) -> list[np.ndarray]:
            out = []
            texts = _read(texts, forms)
            for lo, hi in chunked(texts):
                w = words_of(*explode(texts[lo:hi]), chars)
                out += [w.hashes[a:b] for a, b in zip(w.starts[:-1], w.starts[1:])]
            return out

        def each(column: pa.Array) -> Iterator[np.ndarray]:
            coded = column.dictionary_encode()  # a text comes with each of its partners
            known = hashes(coded.dictionary.to_pylist())
            return (known[c] for c in coded.indices.to_pylist())

        for b in batches:
            found = [_longest(d, i, _shifts(p).tolist()) for d, i, p in zip(each(b.column(2)), each(b.column(3)), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int32()) for x in (zip(*found) if found else ([], [], [])))], ["d", "i", "words", "doc_word", "item_word"])

    runs = pairs.where("item_text is not null and doc_text is not null").select("d", "i", "doc_text", "item_text", "places").mapInArrow(extend, schema).where(F.col("words") >= span)
    best = runs.groupBy("d", "i").agg(F.min(F.struct((-F.col("words")).alias("less"), "doc_word", "item_word")).alias("x"))
    return best.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), (-F.col("x.less")).alias("words"), F.col("x.doc_word"), F.col("x.item_word"))
