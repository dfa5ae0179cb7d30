import math

import pytest

from loomtext.config import Codec, Evaluation, IndexConfig, Info, Optimization, Store
from loomtext.durable import durable
from loomtext.functions.analyze import CLEAN, RAW, positions
from loomtext.operators import index as ix
from loomtext.operators import measure, search
from loomtext.operators.shelf import Shelf

CORPUS = [
    ("doc1", "Python is a programming language. Python is popular."),
    ("doc2", "Machine learning uses Python and algorithms."),
    ("doc3", "Java is also a programming language."),
]
SCHEMA = "doc_id string, content string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA)


@pytest.fixture(scope="module")
def index(docs):
    return ix.build(docs).persist()


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_lengths_and_positions(index):
    assert {r[0]: r[1] for r in index.doc_catalog.collect()} == {"doc1": 5, "doc2": 5, "doc3": 4}
    python = {r["doc_id"]: r["positions"] for r in index.postings.where("term = 'python'").collect()}
    assert python == {"doc1": [0, 3], "doc2": [3]}


@pytest.mark.parametrize(
    ("query", "expected", "compat"),
    [
        ('"programming"', ["doc1", "doc3"], []),
        ('"programming language"', ["doc1", "doc3"], []),
        ('NOT "python"', ["doc3"], ["doc3"]),
        ('"python" AND NOT "java"', ["doc1", "doc2"], ["doc1", "doc2"]),
        ('"java" OR "popular"', ["doc1", "doc3"], ["doc1", "doc3"]),
        ('"__all_docs__"', [], []),
    ],
)
def test_boolean(index, query, expected, compat):
    assert ids(search.boolean_search(index, query)) == expected
    assert ids(search.boolean_search(index, query, analyze_query=False)) == compat


def test_tfidf(index):
    got = {r["doc_id"]: r["tfidf"] for r in ix.weights(index).where("term = 'python'").collect()}
    assert got["doc1"] == pytest.approx(0.4 * math.log(1.5))
    assert got["doc2"] == pytest.approx(0.2 * math.log(1.5))
    assert ids(search.ranked_search(index, '"python"')) == ["doc1", "doc2"]


def test_ranked_variants(index):
    assert set(ids(search.ranked_search(index, '"python" AND NOT "java"'))) == {"doc1", "doc2", "doc3"}
    assert ids(search.ranked_search(index, '"python" AND NOT "popular"', ranked="filtered")) == ["doc2"]
    assert ids(search.ranked_search(index, '"python"', "wordcount", least_score=2.0)) == ["doc1"]
    assert ids(search.ranked_search(index, '"python language"')) == []
    assert ids(search.match_search(index, '"Java" AND popular')) == ["doc3", "doc1"]
    with pytest.raises(ValueError):
        search.ranked_search(index, '"python"', "other").collect()


def test_cut_at_100_and_json(spark):
    many = spark.createDataFrame([(f"d{i:03d}", "word") for i in range(150)], SCHEMA)
    found = search.boolean_search(ix.build(many, RAW), '"word"')
    assert len(ids(found)) == 100 and ids(found)[0] == "d000"
    assert search.results_json(found).first()[0].startswith('[{"doc_id":"d000","score":1.0}')


def test_dirty_documents(spark):
    rows = [("d", "b a"), ("d", "a"), (None, "a"), ("e", ""), ("f", None), ("g", "... --")]
    built = ix.build(spark.createDataFrame(rows, SCHEMA), RAW)
    assert {r[0]: r[1] for r in built.doc_catalog.collect()} == {"d": 2, "e": 0, "f": 0, "g": 0}
    assert {r["term"]: r["positions"] for r in built.postings.collect()} == {"a": [0, 1], "b": [0]}
    assert sorted(ids(search.boolean_search(built, 'NOT "a"'))) == ["e", "f", "g"]


def test_empty_collection(spark):
    built = ix.build(spark.createDataFrame([], SCHEMA), RAW)
    assert ids(search.boolean_search(built, 'NOT "a"')) == []
    assert ix.weights(built).count() == 0
    assert ix.skip_targets(built.postings).count() == 0
    assert ix.doc_gaps(built.postings, built.doc_catalog).count() == 0


def test_gaps_and_skips_over_ranges(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", "a " + ("b" if i % 3 == 0 else "c")) for i in range(100)], SCHEMA)
    built = ix.build(docs, RAW)
    gaps = {(r["term"], r["doc_id"]): r["gap"] for r in ix.doc_gaps(built.postings, built.doc_catalog).collect()}
    assert all(gaps["a", f"d{i:03d}"] == 1 for i in range(100))
    assert all(gaps["b", f"d{i:03d}"] == (3 if i else 1) for i in range(0, 100, 3))
    skips = {r["doc_id"]: (r["ordinal"], r["skip_to"]) for r in ix.skip_targets(built.postings).where("term = 'a'").collect()}
    assert all(skips[f"d{i:03d}"] == (i, i + 10 if i < 90 else None) for i in range(100))
    assert {r["term"]: r["bytes"] for r in ix.vbyte_sizes(ix.doc_gaps(built.postings, built.doc_catalog)).collect()} == {"a": 100, "b": 34, "c": 66}


@pytest.mark.parametrize("config", [IndexConfig(), IndexConfig(store=Store.DB1), IndexConfig(codec=Codec.CLIB), IndexConfig(codec=Codec.CODE, optimization=Optimization.SKIPPING)])
def test_life_on_disk(spark, docs, tmp_path, config):
    shelf = Shelf(spark, str(tmp_path), config)
    assert shelf.list() == [] and not shelf.delete("none")
    with pytest.raises(FileNotFoundError):
        shelf.load("none")
    shelf.create("one", docs)
    assert shelf.list() == ["one"] and shelf.size_mb("one") > 0
    assert ids(search.boolean_search(shelf.load("one"), 'NOT "python"')) == ["doc3"]
    remove = spark.createDataFrame([("doc1",)], "doc_id string")
    add = spark.createDataFrame([("doc3", "Python again"), ("doc4", "Java")], SCHEMA)
    after = shelf.update("one", remove, add)
    assert ids(shelf.list_files("one")) == ["doc2", "doc3", "doc4"]
    assert ids(search.boolean_search(after, '"python"')) == ["doc2", "doc3"]
    assert after.term_stats.where("term = 'python'").first()["df"] == 2
    assert len(shelf.versions("one")) == 2
    assert shelf.delete("one") and shelf.list() == []


def test_identifiers():
    config = IndexConfig.of("SelfIndex", "WORDCOUNT", "DB1", "DOC", "CLIB", "SKIPPING")
    assert config.short_id == "SelfIndex_i2d2c3qDosp"
    assert config.long_id.startswith("core=SelfIndex|index=WORDCOUNT|datastore=DB1")
    with pytest.raises(KeyError):
        IndexConfig.of("SelfIndex", "OTHER", "DB1", "DOC", "CLIB", "SKIPPING")
    with pytest.raises(ValueError):
        IndexConfig(core="Other")


def test_benchmark(spark, docs, tmp_path):
    configs = [IndexConfig(), IndexConfig(evaluation=Evaluation.DOC, info=Info.BOOLEAN), IndexConfig("ESIndex", Info.TFIDF)]
    rows = measure.run_benchmark(spark, str(tmp_path), docs, ['"python"', 'NOT "java"'], configs).collect()
    assert [r["identifier"] for r in rows] == [c.short_id for c in configs]
    assert all(r["p99_latency"] >= r["p95_latency"] > 0 for r in rows)


def test_index_stream(spark, tmp_path):
    from loomtext.streaming.ingest import index_stream

    source = f"{tmp_path}/in"
    shelf = Shelf(spark, f"{tmp_path}/shelf")
    for batch in ([("d1", "forest"), ("d2", "river")], [("d2", "forest now")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        index_stream(stream, shelf, "live", f"{tmp_path}/cp", RAW).awaitTermination()
    assert ids(search.boolean_search(shelf.load("live", RAW), '"forest"')) == ["d1", "d2"]


def test_stop_words_in_queries(index):
    assert ids(search.boolean_search(index, '"programming of language"')) == ["doc1", "doc3"]
    assert index.analyzer == CLEAN


def test_rows_are_grouped_where_they_lie(monkeypatch):
    """Postings of each row by brute force, with long rows, empty ones and slices."""
    import pyarrow as pa

    texts = [["a", "b", "a"], [], None, ["c"] * 250_000 + ["a"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(5)]), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "tokens"])
    for lo in (0, 1, 3):
        got = {}
        for b in ix._row_postings([batch.slice(lo)]):
            for r in b.to_pylist():
                assert (r["doc_id"], r["term"]) not in got
                got[r["doc_id"], r["term"]] = (r["positions"], r["doc_len"])
        assert got == {(f"d{i}", t): ([p for p, x in enumerate(texts[i]) if x == t], len(texts[i])) for i in range(lo, 5) for t in set(texts[i] or [])}


def test_frequent_terms_are_not_gathered(spark, monkeypatch):
    """No exchange on the term alone moves postings or tokens, whether the other side is broadcast or not."""
    docs = spark.createDataFrame([(f"d{i}", "often " * 3 + "abcde"[i % 5] * (i + 3)) for i in range(50)], SCHEMA)
    built = ix.build(docs, RAW).stored(lambda df, name: durable(df, name))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    makers = (lambda: ix.weights(built), lambda: ix.skip_targets(built.postings), lambda: positions(docs, CLEAN))
    small = [make() for make in makers]
    assert all("hashpartitioning(term" not in plan(df) for df in small)
    monkeypatch.setattr("loomtext.operators.skew.BROADCAST_ROWS", 3)
    for before, make in zip(small, makers):
        large = make()
        assert "shufflepartitionidpassthrough" in plan(large) and "hashpartitioning(term" not in plan(large)
        assert sorted(map(str, large.select(before.columns).collect())) == sorted(map(str, before.collect()))
