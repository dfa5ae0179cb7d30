"""How characteristic a term is of a record: two-Poisson mixtures.

Occurrences of a term are taken as a mixture of two Poisson distributions, one for the
few records that are about it (the elite) and one for all others. The mixture of each
term is fitted by expectation-maximisation to its frequency histogram, records without
it included. The posterior probability of the elite at a record's count says how
characteristic the term is of the record. The same histogram gives the document
frequency, hence the classic score count * ln(N / df).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..operators.skew import uneven_join
from .frequency import clean_index

PARAMETERS = "term string, records long, elite_share double, elite_mean double, other_mean double"


def fit_two_poisson(count: np.ndarray, times: np.ndarray, starts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit the mixture of each histogram at once: share and mean of the elite, mean of the others.

    Histogram ``i`` has ``times[j]`` records of ``count[j]`` occurrences for j from ``starts[i]``
    up to the next start; it holds at least one occurrence.
    """
    size = np.diff(np.append(starts, count.size))
    total = np.add.reduceat(times, starts)
    mean = np.add.reduceat(times * count, starts) / total
    some = np.add.reduceat(times * (count > 0), starts)
    share = np.clip(some / total / 2, 1e-12, 0.5)
    high = np.maximum(np.add.reduceat(times * count, starts) / some, mean) + 0.5
    low = np.maximum(mean / 4, 1e-12)
    for _ in range(rounds):
        odds = np.log(share) - np.log1p(-share) - high + low
        z = np.repeat(odds, size) + count * np.repeat(np.log(high) - np.log(low), size)
        elite = times / (1 + np.exp(-np.clip(z, -700, 700)))
        n = np.add.reduceat(elite, starts)
        hits = np.add.reduceat(elite * count, starts)
        share = np.clip(n / total, 1e-12, 1 - 1e-9)
        high = np.maximum(hits / np.maximum(n, 1e-300), 1e-12)
        low = np.maximum((mean * total - hits) / np.maximum(total - n, 1e-9), 1e-12)
    swap = high < low
    return np.where(swap, 1 - share, share), np.where(swap, low, high), np.where(swap, high, low)


def term_mixtures(rows: DataFrame, total: int) -> DataFrame:
    """``PARAMETERS`` of each term of rows ``term``, ``term_count``; ``total`` is the number of records.

    A term whose only count is null or zero has null parameters.
    """
    histogram = rows.groupBy("term", F.coalesce("term_count", F.lit(0)).cast("long").alias("count")).agg(F.count(F.lit(1)).alias("times"))
    # a histogram has at most as many entries as there are distinct counts of a term
    grouped = histogram.groupBy("term").agg(F.collect_list(F.struct("count", "times")).alias("h")).select("term", "h.count", "h.times")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends = b.column(1).offsets.to_numpy()
            count = b.column(1).flatten().to_numpy().astype(np.float64)
            times = b.column(2).flatten().to_numpy().astype(np.float64)
            ends = ends - ends[0]
            df = np.add.reduceat(times, ends[:-1])
            # an entry for the records without the term goes before each histogram
            count = np.insert(count, ends[:-1], 0.0)
            times = np.insert(times, ends[:-1], np.maximum(total - df, 0))
            starts = ends[:-1] + np.arange(df.size)
            empty = np.add.reduceat(count * times, starts) == 0
            with np.errstate(all="ignore"):
                share, high, low = fit_two_poisson(count, times, starts)
            columns = [pa.array(np.where(empty, np.nan, x), from_pandas=True) for x in (share, high, low)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(df.astype(np.int64)), *columns], ["term", "records", "elite_share", "elite_mean", "other_mean"])

    return grouped.mapInArrow(fit, PARAMETERS)


def characteristic_terms(index: DataFrame, catalog: DataFrame, reserved: str = "__all_docs__") -> DataFrame:
    """One row for each record and term: ``doc_id``, ``term``, ``term_count``, ``records``, ``score``, ``elite``.

    ``score`` is count * ln(N / df) to 6 decimals, N the distinct ids of ``catalog``, df the
    records of the term; ``elite`` is the posterior probability of the elite to 6 decimals.
    Terms are compared in lower case without blanks around; null terms and records and the
    reserved key are left out; of several rows of a term and record the latest counts,
    repeated rows once. A null count has null scores, though its record counts for df. An
    empty catalog gives null scores. The index is cleaned once; the parameters of all terms are
    broadcast if they are counted to be few, and else frequent terms are joined in shards.
    """
    rows = durable(clean_index(index, reserved), "postings")
    total = catalog.select("doc_id").where("doc_id is not null").distinct().count()
    mixtures = durable(term_mixtures(rows, total), "mixtures")
    joined = uneven_join(rows, mixtures, "term", ["doc_id"], loads=mixtures.select(F.col("term").alias("key"), F.col("records").alias("n")))
    k = F.col("term_count")
    other = (1 - F.col("elite_share")) / F.col("elite_share") * F.exp(F.col("elite_mean") - F.col("other_mean") + k * (F.ln("other_mean") - F.ln("elite_mean")))
    score = F.when(F.lit(total) > 0, F.round(k * F.ln(F.lit(float(total)) / F.col("records")), 6))
    return joined.select("doc_id", "term", "term_count", "records", score.alias("score"), F.round(1 / (1 + other), 6).alias("elite"))


def elite_terms(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``term`` and ``elite`` where the record is among the term's elite with that probability at least."""
    return scored.where(F.col("elite") >= least).select("doc_id", "term", "elite")


def top_terms(scored: DataFrame) -> DataFrame:
    """``doc_id`` and ``term`` of the highest positive score of each record, all ties included."""
    # a record has at most one row for each distinct term, and the window spills
    best = F.max("score").over(Window.partitionBy("doc_id"))
    return scored.where("score > 0").withColumn("best", best).where("score = best").select("doc_id", "term")
