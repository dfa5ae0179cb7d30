import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import skew

SCHEMA = "term string, doc_id string, postings array<int>, extra int"


def index_rows():
    r = random.Random(3)
    out = [("Hot ", f"d{i % 700}", [1, 2], 0) for i in range(1000)] + [("hot", None, None, 1)] * 5
    out += [(f"t{r.randint(0, 300)}", f"d{r.randint(0, 50)}", [], 2) for _ in range(1500)]
    return out + [(None, "d1", [1], 3), ("", "d1", [4], 3)]


def brute(rows):
    kept = [((t or "").strip(" ").lower(), d, p) for t, d, p, _ in rows if t is not None]
    out = {}
    for t, d, p in kept:
        n, docs, held = out.get(t, (0, set(), 0))
        out[t] = (n + 1, docs | ({d} if d else set()), held + len(p or []))
    return {t: (n, len(docs), held, n * 100 >= len(kept)) for t, (n, docs, held) in out.items()}


@pytest.mark.parametrize("tasks", [1, 4, 13])
def test_term_results(spark, tasks):
    rows = index_rows()
    got = skew.term_results(spark.createDataFrame(rows, SCHEMA), tasks).collect()
    assert {r["term"]: (r["total_rows"], r["records"], r["positions"], r["heavy"]) for r in got} == brute(rows)


def test_rows_are_counted_where_they_are_placed(spark, monkeypatch):
    """Placed rows that are lost or doubled show in the number that decides what is heavy."""
    real = skew.place
    monkeypatch.setattr(skew, "place", lambda df, *a: (lambda x: x.unionByName(x))(real(df, *a)))
    df = spark.createDataFrame(index_rows(), SCHEMA)
    got = {r["term"]: r["total_rows"] for r in skew.term_results(df, 4).collect()}
    assert got == {t: 2 * n for t, (n, *_) in brute(index_rows()).items()}


def test_rows_without_a_record_are_spread(spark):
    """A third of all rows has a hot term and no record."""
    rows = [("hot", None, [1], 0)] * 1000 + [(f"t{i}", f"d{i}", [1], 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    real = skew.place
    with pytest.MonkeyPatch.context() as m:
        m.setattr(skew, "place", lambda *a: seen.append(real(*a)) or seen[-1])
        got = {r["term"]: (r["total_rows"], r["records"]) for r in skew.term_results(df, 8).collect()}
    assert got == {"hot": (1000, 0)} | {f"t{i}": (1, 1) for i in range(2000)}
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / 8


def test_copies_of_a_row_are_spread(spark):
    """A third of all rows are copies of one row, and a record with many rows has several terms."""
    rows = [("hot", "d0", [1], 0)] * 1000 + [(f"t{i % 40}", "d0", [1], 0) for i in range(80)] + [(f"t{i}", f"d{i}", [1], 0) for i in range(2000)] + [("hot", f"d{i}", [1], 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    real = skew.place
    with pytest.MonkeyPatch.context() as m:
        m.setattr(skew, "place", lambda *a: seen.append(real(*a)) or seen[-1])
        got = {r["term"]: (r["total_rows"], r["records"], r["positions"], r["heavy"]) for r in skew.term_results(df, 8).collect()}
    assert got == brute(rows)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / 8


def test_empty_and_null(spark):
    assert skew.term_results(spark.createDataFrame([], SCHEMA)).count() == 0
    assert skew.term_results(spark.createDataFrame([(None, "d", [1], 1)] * 3, SCHEMA)).count() == 0


def test_hot_key_is_spread_evenly(spark):
    df = spark.createDataFrame(index_rows(), SCHEMA).withColumn("term", F.lower(F.trim("term"))).where("term is not null")
    plan = skew.plan_fragments(df, "term", 8)
    sizes = {r["p"]: r["count"] for r in skew.place(df, "term", plan, ["doc_id"]).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()}
    assert max(sizes.values()) < 2 * df.count() / 8
    assert max(plan.loads.values()) < 1.5 * df.count() / 8
    copies = skew.replicate(df.select("term").distinct(), "term", plan).groupBy("term").count().where("count > 1").collect()
    assert [r["term"] for r in copies] == ["hot"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1), ("c", 2), (None, 3), ("b", 1)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("q", "w"), (None, "n")], "k string, w string")
    got = skew.fragment_replicate_join(left, right, "k", ["v"], how, 5).drop("_task")
    expected = left.join(right, "k", how)
    assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_uneven_join(spark, monkeypatch, how):
    """Broadcast where the matching side is counted to be small, placed by load beyond that; the same rows."""
    left = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1), ("c", 2), (None, 3), ("b", 1)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("b", "z"), ("q", "w")], "k string, w string")
    loads = left.groupBy(F.col("k").alias("key")).agg(F.count("*").alias("n"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = skew.uneven_join(left, right, "k", ["v"], how)
    assert "BroadcastHashJoin" in plan(small) and "Exchange hash" not in plan(small)
    expected = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, small.collect())) == expected
    for name in ("BROADCAST_ROWS", "BROADCAST_CHARS"):
        with monkeypatch.context() as m:
            m.setattr(skew, name, 2)
            for given in (None, loads):
                large = skew.uneven_join(left, right, "k", ["v"], how, given)
                assert "passthrough" in plan(large) and large.columns == small.columns
                assert sorted(map(str, large.collect())) == expected


def test_join_refuses(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(df, df, "k", ["v"])
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(df, df.select("k"), "k", ["v"], "right")


def test_no_second_exchange_of_the_large_side(spark):
    df = spark.range(1000).selectExpr("id % 10 as k", "id as v")
    out = skew.fragment_replicate_join(df, spark.range(10).selectExpr("id as k", "id as w"), "k", ["v"], tasks=4).groupBy("_task", "k").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2
    assert "hashpartitioning" not in plan


def test_packing_is_balanced():
    placed, loads = skew.pack_units([("big", 3, 90.0), *((i, 1, 10.0) for i in range(9))], 6)
    assert sum(loads.values()) == pytest.approx(180) and max(loads.values()) <= 40
    assert len(set(placed["big"])) == 3
