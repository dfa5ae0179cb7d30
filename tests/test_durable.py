"""Durable tables: their life, and inputs spread without running anything."""

import os

from pyspark.sql import functions as F

from loomtext.durable import discard, durable, scope, shared_folder, spread


def folders(spark):
    root = shared_folder(spark)
    return {f"{a}/{b}" for a in os.listdir(root) if a.startswith("loomtext-") for b in os.listdir(f"{root}/{a}")}


def test_scope_and_discard(spark):
    before = folders(spark)
    with scope():
        one = durable(spark.range(5), "one")
        two = durable(one.select((F.col("id") + 1).alias("id")), "two")
        stays = durable(spark.range(2), "stays", kept=True)
        assert len(folders(spark) - before) == 3
        discard(one, one, spark.range(1))
        assert two.count() == 5 and len(folders(spark) - before) == 2
    assert [x.split("/")[1].startswith("stays") for x in folders(spark) - before] == [True]
    assert stays.count() == 2
    discard(stays)
    assert folders(spark) == before


def test_a_spared_table_ends_with_the_outer_scope(spark):
    before = folders(spark)
    with scope():
        with scope() as spare:
            one, two = durable(spark.range(3), "one"), spare(durable(spark.range(4), "two"))
            assert one.count() == 3
        assert two.count() == 4 and len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_a_query_leaves_nothing_behind(spark):
    from loomtext.queries import p2_terms

    before = folders(spark)
    with scope():
        assert p2_terms(spark, "/root/testdata/sf0.001").count() > 0
    assert folders(spark) == before


def test_spread_runs_nothing(spark):
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            read.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(count, "id long").groupBy(F.col("id") % 10).count()
    out = spread(df)
    assert read.value == 0
    assert out.count() == 10 and read.value == 1000


def test_spread_uses_all_cores(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide) is wide
