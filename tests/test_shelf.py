"""Indexes on disk: layouts, catalog tables, segments."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomtext.config import IndexConfig, Info, Optimization, Store
from loomtext.functions.analyze import RAW
from loomtext.operators import index as ix
from loomtext.operators import search, shelf
from loomtext.operators.shelf import LAYOUTS, Shelf

SCHEMA = "doc_id string, content string"


def docs(spark, numbers, salt=0):
    r = random.Random(salt)
    return spark.createDataFrame([(f"d{i}", " ".join(["word", *(f"{'abcde'[r.randrange(5)]}x" for _ in range(i % 7 + 3))])) for i in numbers], SCHEMA)


def content(index):
    """All an index says, in comparable form."""
    postings = {(r["term"], r["doc_id"], r["term_count"], tuple(r["positions"])) for r in index.postings.collect()}
    return postings, {tuple(r) for r in index.term_stats.collect()}, {tuple(r) for r in index.doc_catalog.collect()}


@pytest.mark.parametrize("info", list(Info))
def test_layouts(spark, tmp_path, info):
    made = Shelf(spark, str(tmp_path), IndexConfig(info=info)).create("one", docs(spark, range(40)), RAW)
    segment = next(x for x in os.listdir(f"{tmp_path}/one") if x.startswith("s"))
    assert spark.read.parquet(f"{tmp_path}/one/{segment}").columns == LAYOUTS[info]
    built = ix.build(docs(spark, range(40)), RAW)
    assert content(made) == content(built)
    for weight in ("boolean", "wordcount", "tfidf", "bm25"):
        asked = (lambda i: search.match_search(i, "ax bx")) if weight == "bm25" else (lambda i, w=weight: search.ranked_search(i, '"ax" OR "bx"', w))
        assert asked(made).collect() == asked(built).collect()


def test_layouts_differ_in_size(spark, tmp_path):
    sizes = {}
    for info in Info:
        s = Shelf(spark, f"{tmp_path}/{info.name}", IndexConfig(info=info))
        s.create("one", docs(spark, range(400)), RAW)
        sizes[info] = s.size_mb("one")
    assert sizes[Info.BOOLEAN] < sizes[Info.WORDCOUNT] < sizes[Info.TFIDF]


def test_catalog_table_saves_the_exchange(spark, tmp_path):
    config = IndexConfig(store=Store.DB1)
    a, b = Shelf(spark, f"{tmp_path}/a", config), Shelf(spark, f"{tmp_path}/b", config)
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("loomtext_")}
    before = tables()
    first = a.create("same", docs(spark, range(30)), RAW)
    b.create("same", docs(spark, range(5)), RAW)
    assert len(tables() - before) == 2
    assert a.load("same", RAW).doc_catalog.count() == 30 and b.load("same", RAW).doc_catalog.count() == 5
    plan = first.postings.groupBy("term").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    for name in tables() - before:
        spark.sql(f"DROP TABLE {name}")  # as in a session with an empty catalog
    again = a.load("same", RAW)
    assert content(again) == content(ix.build(docs(spark, range(30)), RAW))
    assert "Exchange" not in again.postings.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert a.delete("same") and b.delete("same") and tables() == before
    assert not os.path.exists(f"{tmp_path}/a/same")


@pytest.mark.parametrize("config", [IndexConfig(), IndexConfig(info=Info.BOOLEAN, store=Store.DB1), IndexConfig(optimization=Optimization.SKIPPING)])
def test_updates_equal_a_new_build(spark, tmp_path, monkeypatch, config):
    """A chain of updates says the same as an index of what is left, before and after segments are merged."""
    monkeypatch.setattr(shelf, "MOST_SEGMENTS", 3)
    s = Shelf(spark, str(tmp_path), config)
    s.create("i", docs(spark, range(20)), RAW)
    texts = {r["doc_id"]: r["content"] for r in docs(spark, range(20)).collect()}
    segments = []
    for step in range(5):
        add = docs(spark, range(step * 4, step * 4 + 6), salt=step + 1)
        gone = [f"d{3 * step}", "absent", None]
        s.update("i", spark.createDataFrame([(g,) for g in gone], "doc_id string"), add, RAW)
        for g in gone:
            texts.pop(g, None)
        texts |= {r["doc_id"]: r["content"] for r in add.collect()}
        assert content(s.load("i", RAW)) == content(ix.build(spark.createDataFrame(list(texts.items()), SCHEMA), RAW))
        segments.append(len(s._version("i", s.versions("i")[-1])["segments"]))
    assert segments == [2, 3, 1, 2, 3]
    s.update("i", remove=spark.createDataFrame([(k,) for k in texts], "doc_id string"), analyzer=RAW)
    assert content(s.load("i", RAW)) == (set(), set(), set())
    assert search.boolean_search(s.load("i", RAW), 'NOT "word"').count() == 0


def test_an_update_writes_only_new_postings(spark, tmp_path):
    s = Shelf(spark, str(tmp_path))
    s.create("i", docs(spark, range(100)), RAW)
    old = {x for x in os.listdir(f"{tmp_path}/i") if x.startswith("s")}
    s.update("i", add=docs(spark, [1, 200]), analyzer=RAW)
    new = {x for x in os.listdir(f"{tmp_path}/i") if x.startswith("s")} - old
    assert old <= set(os.listdir(f"{tmp_path}/i")) and len(new) == 1
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/i/{new.pop()}").select("doc_id").distinct().collect()} == {"d1", "d200"}


def test_a_failed_update_leaves_the_index(spark, tmp_path):
    s = Shelf(spark, str(tmp_path))
    s.create("i", docs(spark, range(5)), RAW)
    before = content(s.load("i", RAW))
    bad = docs(spark, [7]).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.update("i", add=bad, analyzer=RAW)
    assert content(s.load("i", RAW)) == before
    s.update("i", add=docs(spark, [7]), analyzer=RAW)
    assert s.list_files("i").count() == 6
