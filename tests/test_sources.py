import json

from loomtext.sources import corpus


def test_pages(spark):
    rows = [("1", " T ", "x\n", 1), ("1", "T", "newer", 2), ("2", None, "  ", 1), (None, "a", "b", 1), ("3", None, "only", 1), ("3", None, "only", 1)]
    df = spark.createDataFrame(rows, "id string, title string, text string, revised_at int")
    assert sorted(map(tuple, corpus.pages(df).collect())) == [("wiki_1", "T newer"), ("wiki_3", "only")]
    assert corpus.pages(df, 1).count() == 1
    assert corpus.pages(df.drop("revised_at")).count() == 4
    assert corpus.pages(df.limit(0)).count() == 0


def test_news_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    bodies = {"a/1.json": {"title": "one", "text": "x"}, "a/b/2.json": {"title": None, "text": "two", "other": 1}, "a/3.json": {}, "z.json": {"text": "last"}}
    for name, body in bodies.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "a/bad.json").write_text("{broken")
    (tmp_path / "a/empty.json").write_text("")
    (tmp_path / "a/list.json").write_text("[1]")
    (tmp_path / "a/note.txt").write_text("{}")
    got = sorted(map(tuple, corpus.news(corpus.read_news(spark, str(tmp_path))).collect()))
    assert got == [("news_0", "one x"), ("news_1", "two"), ("news_2", "last")]
    assert corpus.read_news(spark, f"{tmp_path}/absent").count() == 0


def test_news_delivered_twice(spark):
    df = spark.createDataFrame([("p", '{"text": "old"}', 1), ("p", '{"text": "new"}', 2), ("q", None, 1), (None, '{"text": "x"}', 1)], "path string, body string, loaded_at int")
    assert [tuple(r) for r in corpus.news(df).collect()] == [("news_0", "new")]


def test_numbered_is_dense(spark):
    got = corpus.numbered(spark.range(0, 1000, 1, 7).selectExpr("lpad(id * 7919 % 1000, 4, '0') as k"), "k").orderBy("k").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))


def test_query_file(spark, tmp_path):
    path = tmp_path / "q.json"
    corpus.write_sample_queries(str(path))
    corpus.write_sample_queries(str(path))
    assert [r["query"] for r in corpus.read_queries(spark, str(path)).orderBy("query_id").collect()] == corpus.SAMPLE_QUERIES
    assert corpus.read_queries(spark).count() == len(corpus.SAMPLE_QUERIES)


def test_union_and_sample(spark):
    wiki = spark.createDataFrame([("1", "t", "x")], "id string, title string, text string")
    files = spark.createDataFrame([("p", '{"text": "y"}')], "path string, body string")
    assert {r["doc_id"] for r in corpus.all_documents(wiki, files).collect()} == {"wiki_1", "news_0"}
    assert [r["doc_id"] for r in corpus.sample(corpus.all_documents(wiki, files), 1).collect()] == ["news_0"]
