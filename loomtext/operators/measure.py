"""Measure index creation, size and query latency of configurations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Codec, Evaluation, IndexConfig, Info, Optimization, Store
from ..functions.analyze import CLEAN, Analyzer
from .index import Index
from .search import boolean_search, match_search, ranked_search
from .shelf import Shelf

RESULT_SCHEMA = "identifier string, creation_time double, disk_size_mb double, avg_latency double, p95_latency double, p99_latency double, throughput double, memory_mb double"

# The configurations to compare: one match baseline, and eight variations of one axis each.
CONFIGS = [
    IndexConfig("ESIndex", Info.TFIDF, Store.DB1),
    IndexConfig(info=Info.BOOLEAN),
    IndexConfig(info=Info.WORDCOUNT),
    IndexConfig(),
    IndexConfig(store=Store.DB1),
    IndexConfig(codec=Codec.CODE),
    IndexConfig(codec=Codec.CLIB),
    IndexConfig(evaluation=Evaluation.DOC),
    IndexConfig(optimization=Optimization.SKIPPING),
]


def searcher(config: IndexConfig) -> Callable[[Index, str], DataFrame]:
    """How a configuration answers a query."""
    least = config.least_score if config.optimization is Optimization.THRESHOLDING else None
    early = config.optimization is Optimization.EARLY_STOPPING
    if config.core == "ESIndex":
        return lambda index, q: match_search(index, q, config.most_hits)
    if config.evaluation is Evaluation.TERM:
        return lambda index, q: boolean_search(index, q, n=config.most_hits, least_score=least, early=early)
    return lambda index, q: ranked_search(index, q, config.info.name.lower(), n=config.most_hits, least_score=least, early=early)


def _percentile(values: list[float], p: float) -> float:
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def measure(spark: SparkSession, root: str, docs: DataFrame, queries: Iterable[str], config: IndexConfig, analyzer: Analyzer = CLEAN) -> tuple:
    """One benchmark row. A failing query counts with its time; memory isn't comparable and stays null."""
    shelf = Shelf(spark, f"{root}/{config.short_id}", config)
    began = time.perf_counter()
    index = shelf.create("bench", docs, analyzer)
    created = time.perf_counter() - began
    search, seconds = searcher(config), []
    for q in queries:
        began = time.perf_counter()
        try:
            search(index, q).collect()
        except Exception as e:
            print(f"{config.short_id}: {q}: {type(e).__name__}")
        seconds.append(time.perf_counter() - began)
    if not seconds:
        return (config.short_id, created, shelf.size_mb("bench"), None, None, None, 0.0, None)
    total = sum(seconds)
    return (config.short_id, created, shelf.size_mb("bench"), total / len(seconds), _percentile(seconds, 0.95), _percentile(seconds, 0.99), len(seconds) / total if total else 0.0, None)


def run_benchmark(spark: SparkSession, root: str, docs: DataFrame, queries: list[str], configs: list[IndexConfig] = CONFIGS) -> DataFrame:
    """Benchmark rows of all configurations; one that fails is reported and left out."""
    rows = []
    for config in configs:
        try:
            rows.append(measure(spark, root, docs, queries, config))
        except Exception as e:
            print(f"{config.short_id}: {type(e).__name__}: {e}")
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def write_results(results: DataFrame, path: str) -> None:
    """Benchmark rows, a handful, as a JSON list in one text file of a folder; ``read_results`` reads it."""
    whole = results.agg(F.to_json(F.collect_list(F.struct(*results.columns)), {"ignoreNullFields": "false"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
