"""Reports: word frequencies, grouped means of benchmark rows, percentiles, ratios, histograms, tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyze import CLEAN, RAW, positions
from ..sources.corpus import numbered

#: Position of each axis in an identifier such as SelfIndex_i3d1c1qTo0.
AXES = {"info": "i", "dstore": "d", "compr": "c", "qproc": "q", "optim": "o"}
# Display names of the axes' values.
NAMES = {
    "info": {"1": "Boolean", "2": "WordCount", "3": "TF-IDF"},
    "dstore": {"1": "Custom/Pickle", "2": "SQLite", "3": "PostgreSQL"},
    "compr": {"1": "None", "2": "VByte", "3": "zlib"},
    "qproc": {"T": "TAAT", "D": "DAAT"},
    "optim": {"0": "None", "sp": "Skip Pointers", "th": "Threshold", "es": "Early Stop"},
}
METRICS = ("creation_time", "disk_size_mb", "avg_latency", "p95_latency", "p99_latency", "throughput", "memory_mb")


def word_frequency(docs: DataFrame, clean: bool = False) -> DataFrame:
    """``term`` and ``n`` over ``doc_id``, ``content``, before or after analysis."""
    return positions(docs, CLEAN if clean else RAW).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_words(frequency: DataFrame, n: int = 30) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "term").limit(n)


def with_axes(results: DataFrame) -> DataFrame:
    """Benchmark rows with a column for each axis and the ``core``; a malformed identifier has empty axes."""
    pattern = r"^([^_]+)_i(\d)d(\d)c(\d)q([TD])o(\w+)$"
    parts = ["core", *AXES]
    return results.select("*", *(F.regexp_extract("identifier", pattern, i + 1).alias(p) for i, p in enumerate(parts)))


def axis_means(results: DataFrame) -> DataFrame:
    """Means of all metrics for each value of each axis in one grouping-sets plan: ``axis``, ``value``, ``configs``, metrics.

    Rows with an identifier of another form are left out; nulls don't count.
    """
    rows = with_axes(results).where("core <> ''")
    axes = list(AXES)
    name = F.expr("CASE " + " ".join(f"WHEN grouping({a}) = 0 THEN '{a}'" for a in axes) + " END")
    return rows.groupingSets([[F.col(a)] for a in axes], *(F.col(a) for a in axes)).agg(name.alias("axis"), F.coalesce(*(F.col(a) for a in axes)).alias("value"), F.count(F.lit(1)).alias("configs"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS)).select("axis", "value", "configs", *METRICS)


def axis_report(results: DataFrame, axis: str) -> DataFrame:
    """Means for the values of one axis, with their display names as ``label``."""
    names = NAMES[axis]
    label = F.coalesce(*(F.when(F.col("value") == k, v) for k, v in names.items()), F.col("value"))
    return axis_means(results).where(F.col("axis") == axis).select(label.alias("label"), "configs", *METRICS)


def baseline_ratio(results: DataFrame, axis: str, metric: str, baseline: str) -> DataFrame:
    """``value``, mean, and how many times larger the baseline value's mean is; 0 where the mean is not positive."""
    means = axis_means(results).where(F.col("axis") == axis).select("value", F.col(metric).alias("mean"))
    base = F.max(F.when(F.col("value") == baseline, F.col("mean"))).over(Window.partitionBy())  # a handful of values
    return means.withColumn("ratio", F.when(F.col("mean") > 0, F.round(base / F.col("mean"), 6)).otherwise(F.lit(0.0)))


def percentiles(rows: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Count and mean, and exact percentiles with linear interpolation, of each group: ``by``, ``n``, ``mean``, ``p95``, ``p99``.

    Values are sorted in ranges over all tasks and only the few next to a percentile are
    gathered, so a group is never held in one task. Nulls don't count; a group of nulls has
    null percentiles; a null group is a group.
    """
    kept = rows.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    stats = kept.groupBy("_by").agg(F.count("_v").alias("n"), F.round(F.avg("_v"), 6).alias("mean"))
    ordered = numbered(kept.where("_v is not null"), "_by", "_v")
    # one row for each group
    bounds = ordered.groupBy("_by").agg(F.min("ordinal").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("_by", "_key")
    placed = ordered.join(bounds, F.col("_by").eqNullSafe(F.col("_key"))).withColumn("_rank", F.col("ordinal") - F.col("_first"))
    columns = []
    for p in at:
        exact = (F.col("_n") - 1) * F.lit(p)
        low = F.floor(exact)
        weight = F.when(F.col("_rank") == low, 1 - (exact - low)).when(F.col("_rank") == low + 1, exact - low)
        columns.append(F.round(F.sum(F.col("_v") * weight), 6).alias(f"p{round(100 * p)}"))
    found = placed.groupBy("_key").agg(*columns)
    return stats.join(found, stats["_by"].eqNullSafe(found["_key"]), "left").select(F.col("_by").alias(by), "n", "mean", *(f"p{round(100 * p)}" for p in at))


def throughput(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """Queries for each second of each group; 0 without time."""
    total = F.sum(seconds)
    return rows.groupBy(by).agg(F.count(seconds).alias("n"), F.round(F.when(total > 0, F.count(seconds) / total).otherwise(F.lit(0.0)), 6).alias("per_second"))


def histogram(rows: DataFrame, value: str, bins: int = 15) -> DataFrame:
    """``bin`` from 0, ``low``, ``high`` and ``n`` of equal-width bins, the last closed; empty bins included.

    Nulls are left out. If all values are equal the range is widened by a half to both sides.
    """
    edges = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).where("lo is not null")
    wide = edges.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    # the edges are one row
    own = rows.select(F.col(value).cast("double").alias("v")).where("v is not null").join(F.broadcast(wide))
    counted = own.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = wide.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", width.alias("w"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def fastest(results: DataFrame, n: int = 10) -> DataFrame:
    """The configurations of least average latency, names shortened; ties by identifier and run."""
    name = F.replace(F.replace("identifier", F.lit("SelfIndex_"), F.lit("")), F.lit("ESIndex_"), F.lit("ES_"))
    return results.where("avg_latency is not null").orderBy("avg_latency", "identifier", "run_at").limit(n).select(name.alias("name"), "avg_latency")


def first_rows(results: DataFrame, n: int = 6) -> DataFrame:
    """The first rows by run with a label of 15 characters and latency in ms."""
    return results.orderBy("run_at", "identifier", "avg_latency").limit(n).select(F.substring("identifier", 1, 15).alias("label"), milliseconds("p95_latency").alias("p95_ms"), "throughput", "disk_size_mb", "memory_mb")


def milliseconds(column: str) -> Column:
    return F.round(F.col(column) * 1000, 6)


def chart(results: DataFrame, axis: str, labels: dict[str, str], columns: list[Column], core: str | None = None, otherwise: int = 0) -> DataFrame:
    """A row for each benchmark row whose axis value has a label: ``identifier``, ``label`` and ``columns``.

    If there is none, the first ``otherwise`` rows by run are shown, labelled by the first 20
    characters of their identifiers.
    """
    rows = with_axes(results)
    if core:
        rows = rows.where(F.contains("identifier", F.lit(core)))
    label = F.coalesce(*(F.when(F.col(axis) == k, v) for k, v in labels.items()))
    labelled = rows.where(F.col(axis).isin(list(labels))).select("identifier", label.alias("label"), *columns)
    if not otherwise or not labelled.isEmpty():
        return labelled
    first = rows.orderBy("run_at", "identifier", "avg_latency").limit(otherwise)
    return first.select("identifier", F.substring("identifier", 1, 20).alias("label"), *columns)
