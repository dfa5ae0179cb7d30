import json

import pytest

from loomtext import __main__ as cli
from loomtext.config import Evaluation, IndexConfig, Optimization
from loomtext.engine import SearchEngine
from loomtext.functions.analyze import RAW
from loomtext.operators import index as ix
from loomtext.operators import search

from .test_index import CORPUS, SCHEMA


def test_life(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        engine.query('"python"')
    engine.create_index("a", CORPUS)
    assert json.loads(engine.query('"programming"')) == [{"doc_id": "doc1", "score": 1.0}, {"doc_id": "doc3", "score": 1.0}]
    assert json.loads(engine.query('"nothing"')) == []
    engine.update_index("a", ["doc1"], [("doc4", "programs")])
    assert [r["doc_id"] for r in json.loads(engine.query('"program"'))] == ["doc3", "doc4"]
    again = SearchEngine(spark, str(tmp_path))
    again.load_index("a")
    assert [r["doc_id"] for r in again.list_indexed_files("a").collect()] == ["doc2", "doc3", "doc4"]
    assert engine.list_indices() == ["a"]
    engine.delete_index("a")
    assert engine.list_indices() == []


def test_ranked(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path), IndexConfig(evaluation=Evaluation.DOC))
    engine.create_index("a", spark.createDataFrame(CORPUS, SCHEMA))
    got = json.loads(engine.query('"python" AND NOT "java"'))
    assert [r["doc_id"] for r in got] == ["doc3", "doc1", "doc2"] and got[0]["score"] > got[1]["score"]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(CORPUS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    common = ["--docs", f"{tmp_path}/docs", "--root", f"{tmp_path}/root"]
    cli.main(["words", *common])
    cli.main(["index", *common])
    cli.main(["query", '"java"', *common])
    assert '[{"doc_id":"doc3","score":1.0}]' in capsys.readouterr().out


def test_reports_of_a_stored_file(spark, tmp_path):
    row = {"identifier": "SelfIndex_i3d1c1qTo0", "creation_time": 1.0, "disk_size_mb": 2.0, "avg_latency": 0.1, "p95_latency": 0.2, "p99_latency": 0.3, "throughput": 9.0, "memory_mb": None}
    (tmp_path / "results.json").write_text(json.dumps([row, row | {"identifier": "SelfIndex_i3d2c1qTosp", "avg_latency": 0.3}], indent=2))
    cli.main(["reports", "--results", f"{tmp_path}/results.json", "--root", f"{tmp_path}/root"])
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/root/reports/{name}").collect()
    assert sorted((r["label"], r["p95_ms"]) for r in read("chart_datastores")) == [("Custom (y=1)", "200.0"), ("DB1 (y=2)", "200.0")]
    assert [r["name"] for r in read("fastest")] == ["i3d1c1qTo0", "i3d2c1qTosp"]


def test_a_failing_step_is_reported(spark, tmp_path, capsys):
    spark.createDataFrame(CORPUS, SCHEMA).write.parquet(f"{tmp_path}/docs")
    cli.main(["all", "--docs", f"{tmp_path}/docs", "--root", f"{tmp_path}/root", "--queries", f"{tmp_path}/absent.json"])
    out = capsys.readouterr().out
    assert "benchmark: AnalysisException" in out and "reports: AnalysisException" in out


@pytest.mark.parametrize(("optimization", "expected"), [("EARLY_STOPPING", ["doc3"]), ("THRESHOLDING", ["doc3"]), ("NONE", ["doc3", "doc1", "doc2"])])
def test_optimizations(spark, tmp_path, optimization, expected):
    """Rarest terms first: java alone promises one document; the threshold leaves out lower scores."""
    config = IndexConfig(evaluation=Evaluation.DOC, optimization=Optimization[optimization], least_score=0.2, most_hits=1 if optimization == "EARLY_STOPPING" else 100)
    engine = SearchEngine(spark, str(tmp_path), config)
    engine.create_index("a", CORPUS)
    assert [r["doc_id"] for r in json.loads(engine.query('"python" OR "java"'))] == expected
    boolean = IndexConfig(optimization=config.optimization, least_score=1.5, most_hits=config.most_hits)
    engine = SearchEngine(spark, str(tmp_path), boolean)
    engine.create_index("a", CORPUS)
    found = {r["doc_id"] for r in json.loads(engine.query('"python" OR "java"'))}
    assert found <= {"doc1", "doc2", "doc3"} and len(found) == {"EARLY_STOPPING": 1, "THRESHOLDING": 0, "NONE": 3}[optimization]


def test_early_stopping_scores_are_whole(spark):
    built = ix.build(spark.createDataFrame([(f"d{i}", "often " * (i + 1) + ("rare" if i in (3, 7) else "")) for i in range(10)], SCHEMA), RAW).persist()
    whole = {r["doc_id"]: r["score"] for r in search.ranked_search(built, '"often" OR "rare"').collect()}
    early = {r["doc_id"]: r["score"] for r in search.ranked_search(built, '"often" OR "rare"', n=2, early=True).collect()}
    assert early == {k: whole[k] for k in ("d3", "d7")}
    assert search.rarest_terms(built, ["often", "rare", "none"], 3) == ["rare", "often"]


def test_match_batch_equals_single_matches(spark):
    built = ix.build(spark.createDataFrame(CORPUS, SCHEMA)).persist()
    asked = {1: '"Java" AND popular', 2: "python", 3: "the", 4: None, 5: "python python language"}
    got = {}
    for r in search.match_batch(built, spark.createDataFrame(list(asked.items()), "query_id int, query string"), 2).collect():
        got.setdefault(r["query_id"], set()).add((r["doc_id"], r["score"]))
    assert got == {k: {tuple(r) for r in search.match_search(built, q or "", 2).collect()} for k, q in asked.items() if k not in (3, 4)}
