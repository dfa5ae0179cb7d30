import random

import numpy as np
import pytest

from loomtext.operators import report

SCHEMA = "identifier string, creation_time double, disk_size_mb double, avg_latency double, p95_latency double, p99_latency double, throughput double, memory_mb double, run_at int"


def results(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_axis_means_with_dirt(spark):
    df = results(spark, [("SelfIndex_i1d1c1qTo0", 1.0, 2.0, 4.0, None, 1.0, 1.0, None, 1), ("SelfIndex_i1d2c1qDosp", 3.0, None, 2.0, None, 1.0, 1.0, None, 2), ("odd", 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 3), (None, *[None] * 7, 4)])
    got = {(r["axis"], r["value"]): (r["configs"], r["creation_time"], r["disk_size_mb"], r["p95_latency"]) for r in report.axis_means(df).collect()}
    assert got["info", "1"] == (2, 2.0, 2.0, None)
    assert got["dstore", "2"] == (1, 3.0, None, None)
    assert got["optim", "sp"][0] == 1 and len(got) == 8
    ratio = {r["value"]: r["ratio"] for r in report.baseline_ratio(df, "dstore", "avg_latency", "1").collect()}
    assert ratio == {"1": 1.0, "2": 2.0}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 5, 10]] + [(None,)], "v double")
    got = [(r["bin"], r["n"]) for r in report.histogram(df, "v", 2).orderBy("bin").collect()]
    assert got == [(0, 2), (1, 2)]
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert sum(r["n"] for r in report.histogram(same, "v").collect()) == 4
    assert report.histogram(same.limit(0), "v").count() == 0


def test_throughput_guard(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("b", 2.0), ("c", None)], "k string, s double")
    assert {r["k"]: r["per_second"] for r in report.throughput(df, "k", "s").collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_percentiles_by_brute_force(spark):
    r = random.Random(3)
    values = {"a": [r.random() for _ in range(501)], "b": [7.0], "c": [1.0, 2.0], None: [5.0, 5.0, 5.0, 9.0], "big": [float(r.randrange(10)) for _ in range(3000)], "empty": []}
    rows = [(k, v) for k, x in values.items() for v in [*x, None]]
    got = {x["k"]: x for x in report.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        assert got[k]["n"] == len(x)
        for p in (95, 99):
            assert got[k][f"p{p}"] == (pytest.approx(np.percentile(x, p), abs=2e-6) if x else None)
    assert report.percentiles(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_percentiles_hold_no_group_in_one_task(spark):
    df = spark.range(1000).selectExpr("'one' as k", "id * 1.0 as v")
    assert "percentile(" not in report.percentiles(df, "k", "v")._jdf.queryExecution().optimizedPlan().toString()


def test_chart_without_labels_shows_the_first_rows(spark):
    df = results(spark, [(f"SelfIndex_i1d9c1qTo{i}", 1.0, 2.0, 4.0, 0.5, 1.0, 1.0, None, i) for i in range(5)] + [("ESIndex_i1d1c1qTo0", 1.0, 2.0, 4.0, 0.1, 1.0, 1.0, None, 0)])
    columns = [report.milliseconds("p95_latency").alias("p95_ms")]
    got = report.chart(df, "dstore", {"1": "Custom"}, columns, "SelfIndex", 3).collect()
    assert [(r["label"], r["p95_ms"]) for r in got] == [(f"SelfIndex_i1d9c1qTo{i}", 500.0) for i in range(3)]
    assert report.chart(df, "dstore", {"1": "Custom"}, columns, "SelfIndex").count() == 0
    assert [r["label"] for r in report.chart(df, "dstore", {"9": "Nine"}, columns, "SelfIndex", 3).collect()] == ["Nine"] * 5
