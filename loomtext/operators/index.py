"""Positional inverted index: build, weights and physical features.

An index is three tables: ``postings(term, doc_id, term_count, positions, doc_len)``, kept in
ranges of terms so that row-group statistics answer a lookup; ``term_stats(term, df)``; and
``doc_catalog(doc_id, doc_len)``, which also holds documents without terms. A posting
repeats its document's length, so ranking joins nothing of the catalog's size. Weights
depend on the whole collection, so they are computed when read, never stored. A join on the
term never gathers a frequent one in a task. ``shelf.py`` keeps indexes on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, spread
from ..functions.analyze import CLEAN, Analyzer, word_tokens
from ..functions.porter import stem_words
from ..sources.corpus import numbered
from .skew import uneven_join


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    term_stats: DataFrame
    doc_catalog: DataFrame
    analyzer: Analyzer

    @cached_property
    def size(self) -> tuple[int, float]:
        """Number of documents and their mean length, counted once."""
        n, mean = self.doc_catalog.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        return n, float(mean or 0)

    def persist(self) -> Index:
        """Keep the tables in memory for many queries."""
        return Index(self.postings.persist(), self.term_stats.persist(), self.doc_catalog.persist(), self.analyzer)

    def stored(self, keep: Callable[[DataFrame, str], DataFrame]) -> Index:
        """The index with each table passed through ``keep``, which writes it and reads it back.

        Both statistics come from the written postings, so texts are analyzed once.
        """
        ids = self.doc_catalog.select("doc_id")
        postings = keep(self.postings, "postings")
        return Index(postings, keep(document_frequency(postings), "term_stats"), keep(doc_lengths(postings, ids), "doc_catalog"), self.analyzer)


def build(docs: DataFrame, analyzer: Analyzer = CLEAN) -> Index:
    """Index documents ``doc_id`` (compared as a string) and ``content``.

    A document that comes several times is one document: positions of all its rows are
    kept, each counted from 0, and its length is that of its longest row. A null or empty
    content has length 0 and no postings. Null ids are left out.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").where("doc_id is not null")
    tokens = spread(docs).select("doc_id", word_tokens(F.col("content"), analyzer.stop_words).alias("tokens"))
    surface = tokens.mapInArrow(_row_postings, "term string, doc_id string, positions array<int>, doc_len int")
    if analyzer.stem:
        # words of one stem are merged after grouping, when there are fewer rows than tokens
        surface = durable(surface, "surface")
        stems = durable(stem_words(surface.select("term").distinct()), "stems")
        surface = uneven_join(surface, stems, "term", ["doc_id"]).select(F.col("stem").alias("term"), "doc_id", "positions", "doc_len")
    # a document's rows were grouped where they lay; this adds up words of one stem and rows of one document
    merged = surface.groupBy("term", "doc_id").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.max("doc_len").alias("doc_len"))
    postings = merged.select("term", "doc_id", F.size("positions").alias("term_count"), F.sort_array("positions").alias("positions"), "doc_len")
    return Index(postings, document_frequency(postings), doc_lengths(postings, docs.select("doc_id")), analyzer)


def _row_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each row ``doc_id``, ``tokens`` by itself, some 200,000 tokens at a time."""
    for b in batches:
        ends = b.column(1).offsets.to_numpy()
        cuts = np.searchsorted(ends, np.arange(ends[0], ends[-1], 200_000))
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows]):
            if hi <= lo or ends[hi] == ends[lo]:
                continue
            size = np.diff(ends[lo : hi + 1])
            doc = np.repeat(np.arange(lo, hi), size)
            coded = b.column(1).values.slice(int(ends[lo]), int(ends[hi] - ends[lo])).dictionary_encode()
            code = coded.indices.to_numpy()
            at = (np.arange(doc.size) - np.repeat(ends[lo:hi] - ends[lo], size)).astype(np.int32)
            order = np.lexsort((at, code, doc))
            doc, code, at = doc[order], code[order], at[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, at.size).astype(np.int32)), pa.array(at))
            length = pa.array(size[doc[first] - lo].astype(np.int32))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), b.column(0).take(pa.array(doc[first])), places, length], ["term", "doc_id", "positions", "doc_len"])


def doc_lengths(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``doc_len``, 0 without postings, of all distinct ids."""
    lengths = postings.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return ids.distinct().join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: int) -> Column:
    """Natural logarithm of the inverse document frequency, without smoothing."""
    return F.ln(F.lit(float(n)) / df)


def tf(count: Column, length: Column) -> Column:
    return F.when(length > 0, count / length).otherwise(F.lit(0.0))


def with_lengths(index: Index, postings: DataFrame) -> DataFrame:
    """Postings with ``doc_len``, from the catalog where the stored form leaves it out."""
    return postings if "doc_len" in postings.columns else postings.join(index.doc_catalog.select("doc_id", "doc_len"), "doc_id")


def weights(index: Index, postings: DataFrame | None = None) -> DataFrame:
    """Postings with ``tf``, ``idf`` and ``tfidf``; those of some terms only if ``postings`` are given."""
    stats = index.term_stats
    postings = with_lengths(index, index.postings if postings is None else postings)
    joined = uneven_join(postings, stats, "term", ["doc_id"], loads=stats.select(F.col("term").alias("key"), F.col("df").alias("n")))
    weighted = joined.withColumn("tf", tf(F.col("term_count"), F.col("doc_len"))).withColumn("idf", idf(F.col("df"), index.size[0]))
    return weighted.withColumn("tfidf", F.col("tf") * F.col("idf")).drop("df", "doc_len")


def skip_targets(postings: DataFrame) -> DataFrame:
    """Postings in the order of documents with ``ordinal`` and ``skip_to``, floor(sqrt(n)) further on or null.

    A frequent term is ordered in ranges over many tasks, not in one.
    """
    placed = numbered(postings, "term", "doc_id").withColumnRenamed("ordinal", "_global")
    terms = durable(placed.groupBy("term").agg(F.min("_global").alias("_first"), F.count(F.lit(1)).alias("_n")), "terms")
    joined = uneven_join(placed, terms, "term", ["doc_id"], loads=terms.select(F.col("term").alias("key"), F.col("_n").alias("n")))
    out = joined.withColumn("ordinal", F.col("_global") - F.col("_first"))
    to = F.col("ordinal") + F.floor(F.sqrt("_n")).cast("long")
    return out.withColumn("skip_to", F.when(to < F.col("_n"), to)).drop("_global", "_first", "_n")


def doc_gaps(postings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``term``, ``doc_id`` and ``gap``: the step to the next document number of the term, from 0 before the first.

    Documents are numbered from 1 in the order of their ids. Postings are sorted by range, so
    a frequent term spans many tasks; each takes differences along its range, and a range's
    first row is completed from the last row before it.
    """
    numbers = numbered(catalog.select("doc_id"), "doc_id").select("doc_id", (F.col("ordinal") + 1).alias("n"))
    rows = postings.select("term", "doc_id").join(numbers, "doc_id").select("term", "doc_id", "n")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            term, n = b.column(0), b.column(2).to_numpy()
            same = np.append(False, pc.equal(term.slice(1), term.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False))
            gap = n.copy()
            gap[1:] -= np.where(same[1:], n[:-1], 0)
            opens = np.zeros(b.num_rows, bool)
            if last is None:
                opens[0] = True
            elif last[0] == term[0].as_py():
                gap[0] -= last[1]
            last = (term[b.num_rows - 1].as_py(), int(n[-1]))
            yield pa.RecordBatch.from_arrays([term, b.column(1), b.column(2), pa.array(gap), pa.array(np.full(b.num_rows, part, np.int64)), pa.array(opens)], ["term", "doc_id", "n", "gap", "part", "opens"])

    ordered = rows.repartitionByRange("term", "n").sortWithinPartitions("term", "n")
    partial = durable(ordered.mapInArrow(differences, "term string, doc_id string, n long, gap long, part long, opens boolean"), "gaps")
    ends = partial.groupBy("part").agg(F.max(F.struct("term", "n")).alias("last"))
    # one row for each partition
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    whole = partial.join(F.broadcast(before), "part")
    missing = F.when(F.col("opens") & (F.col("before.term") == F.col("term")), F.col("before.n")).otherwise(F.lit(0))
    return whole.select("term", "doc_id", (F.col("gap") - missing).alias("gap"))


def vbyte_sizes(gaps: DataFrame) -> DataFrame:
    """``term``, ``postings`` and ``bytes`` of its gaps in a variable-byte code of 7 bits a byte."""
    length = F.when(F.col("gap") < 128, 1).when(F.col("gap") < 16384, 2).when(F.col("gap") < 2097152, 3).when(F.col("gap") < 268435456, 4).otherwise(5)
    return gaps.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum(length).alias("bytes"))


def changed(index: Index, remove: DataFrame | None = None, add: DataFrame | None = None) -> Index:
    """The index after removing and then adding documents, with all statistics new."""
    gone = remove.select(F.col("doc_id").cast("string").alias("doc_id")) if remove is not None else None
    fresh = build(add, index.analyzer) if add is not None else None
    if fresh is not None:
        new_ids = fresh.doc_catalog.select("doc_id")
        gone = new_ids if gone is None else gone.unionByName(new_ids)
    if gone is None:
        return index
    gone = gone.distinct()
    columns = ["term", "doc_id", "term_count", "positions", "doc_len"]
    postings = with_lengths(index, index.postings).select(columns).join(gone, "doc_id", "left_anti").select(columns)
    catalog = index.doc_catalog.join(gone, "doc_id", "left_anti")
    if fresh is not None:
        postings = postings.unionByName(fresh.postings.select(columns))
        catalog = catalog.unionByName(fresh.doc_catalog)
    return Index(postings, document_frequency(postings), catalog, index.analyzer)


def indexed_files(index: Index) -> DataFrame:
    """Distinct ids of indexed documents in order."""
    return index.doc_catalog.select("doc_id").distinct().orderBy("doc_id")
