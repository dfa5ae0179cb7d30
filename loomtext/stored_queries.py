"""Registered queries over stored indexes, files and measurements, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Codec, Evaluation, IndexConfig, Info, Optimization, Store
from .durable import durable, shared_folder
from .functions.analyze import RAW, tokens_sql
from .operators import measure, search
from .operators.shelf import LAYOUTS, Shelf
from .plans.query import parse
from .queries import _NEWS, _PAGES, Query, _has, _index, _ranked_sql, _results, load_news, load_wikipedia
from .sources import corpus

#: Queries and their trees, malformed ones among them.
TREES = {
    '"a" "b"': 'Term("a")',
    '"a" NOT "b"': 'Term("a")',
    'NOT NOT "a"': 'NOT(Term("a"))',
    '"a" AND NOT NOT "b"': '(NOT(Term("a")) AND NOT(Term("b")))',
    '"a" AND': 'Term("a")',
    '"a" and "b"': 'Term("a")',
    "foo": 'Term("")',
    'BAND "x"': 'Term("x")',
    '"" AND "x"': 'Term("AND")',
    '"a" OR "b" AND "c"': '(Term("a") OR (Term("b") AND Term("c")))',
    '("a" OR "b c") AND "d"': "((Term(\"a\") OR Phrase(['b', 'c'])) AND Term(\"d\"))",
    '"a") OR ("b"': '(Term("a") OR Term("b"))',
}
MATCHES = {1: '"forest glacier" river', 2: "(judge) court", 3: "qqqqqq", 4: 'the "judge"'}
SAMPLE = ['"forest"', '"judge" AND NOT "court"', '"it\'s" OR "the end"', "", "nothing quoted"]


@contextmanager
def _shelf(spark: SparkSession, config: IndexConfig | None = None) -> Iterator[Shelf]:
    """A shelf of its own in the shared folder, emptied at the end."""
    shelf = Shelf(spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}", config)
    try:
        yield shelf
    finally:
        for name in shelf.list():
            shelf.delete(name)
        shelf._fs().delete(shelf._path(), True)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def query_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, [(q, repr(parse(q))) for q in TREES], "query string, tree string")


def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Create a stored index, update it and search it."""
    with _shelf(spark) as shelf:
        shelf.create("pages", load_wikipedia(spark, sf), RAW)
        after = shelf.update("pages", add=load_news(spark, sf), analyzer=RAW)
        return durable(search.boolean_search(after, '"the" AND NOT "forest"', n=None), "roundtrip")


def index_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Create, list, count files and size, remove, create anew, delete."""
    steps: list[tuple] = []
    with _shelf(spark) as shelf:

        def note(step: str) -> None:
            names = shelf.list()
            files = shelf.list_files("news").count() if "news" in names else 0
            steps.append((len(steps), step, ",".join(names), files, "news" in names and shelf.size_mb("news") > 0))

        news = durable(load_news(spark, sf), "news")
        note("start")
        shelf.create("news", news, RAW)
        shelf.create("other", news.limit(0), RAW)
        note("created")
        shelf.update("news", remove=news.where("doc_id like '%0'"), analyzer=RAW)
        note("removed")
        shelf.create("news", news, RAW)
        note("again")
        shelf.delete("news")
        note("deleted")
    return _rows(spark, steps, "at int, step string, names string, files long, has_size boolean")


def _stored(spark: SparkSession, sf: str, configs: dict[str, IndexConfig]) -> DataFrame:
    """What is read back of the news under several configurations."""
    news = durable(load_news(spark, sf), "news")
    rows = []
    for name, config in configs.items():
        with _shelf(spark, config) as shelf:
            index = shelf.create("news", news, RAW)
            n, positions = index.postings.select(F.size("positions").alias("k")).agg(F.count("k"), F.sum("k")).first()
            found = search.boolean_search(index, '"the" AND NOT "forest"', n=None).count()
            rows.append((name, ",".join(LAYOUTS[config.info]), n, positions, found))
    return _rows(spark, rows, "name string, columns string, postings long, positions long, found long")


LAYOUT_CONFIGS = {i.name: IndexConfig(info=i) for i in Info}
CODEC_CONFIGS = {c.name: IndexConfig(codec=c) for c in Codec} | {"SKIPPING": IndexConfig(optimization=Optimization.SKIPPING)}
STORE_CONFIGS = {s.name: IndexConfig(store=s) for s in Store}


def index_layouts(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, LAYOUT_CONFIGS)


def index_codecs(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, CODEC_CONFIGS)


def index_stores(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, STORE_CONFIGS)


def _configured(config: IndexConfig, query: str) -> Query:
    return lambda spark, sf: measure.searcher(config)(_index(spark, sf), query)


def match_batch(spark: SparkSession, sf: str) -> DataFrame:
    return search.match_batch(_index(spark, sf), _rows(spark, list(MATCHES.items()), "query_id int, query string"))


def query_file(spark: SparkSession, sf: str) -> DataFrame:
    """A file of queries is written and read; without a file there are sample queries."""
    path = f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(SAMPLE),)], "value string").coalesce(1).write.text(path)
    own = durable(corpus.read_queries(spark, path), "queries").withColumn("origin", F.lit("file"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return own.unionByName(corpus.read_queries(spark).withColumn("origin", F.lit("sample")))


def results_file(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows written as JSON and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    measure.write_results(_results(spark, sf).drop("run_at"), path)
    out = durable(corpus.read_results(spark, path), "results")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return out


def benchmark_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows of three configurations, what can be told without a clock."""
    configs = [IndexConfig("ESIndex", store=Store.DB1), IndexConfig(info=Info.BOOLEAN), IndexConfig(evaluation=Evaluation.DOC)]
    with _shelf(spark) as shelf:
        rows = measure.run_benchmark(spark, shelf.root, durable(load_news(spark, sf), "news"), ['"forest"', '"the end"'], configs)
        told = durable(rows.selectExpr("identifier", "creation_time > 0 and disk_size_mb > 0 as made", "p99_latency >= p95_latency and p95_latency >= 0.5 * avg_latency and avg_latency > 0 as ordered", "throughput > 0 as has_throughput", "memory_mb is null as no_memory"), "benchmark")
        return told


_PLAIN = (query_trees, index_roundtrip, index_lifecycle, index_layouts, index_codecs, index_stores, match_batch, query_file, results_file, benchmark_rows)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in _PLAIN} | {
        "early_stopping_top10": _configured(IndexConfig(evaluation=Evaluation.DOC, optimization=Optimization.EARLY_STOPPING, most_hits=10), '"glacier" OR "forest" OR "the"'),
        "thresholding_top100": _configured(IndexConfig(evaluation=Evaluation.DOC, optimization=Optimization.THRESHOLDING, least_score=0.02), '"glacier" OR "forest"'),
        "thresholding_boolean": _configured(IndexConfig(optimization=Optimization.THRESHOLDING, least_score=1.5), '"glacier" OR "forest"'),
    }


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"


def oracle_sql() -> dict[str, str]:
    union = f"SELECT * FROM ({_PAGES}) UNION ALL SELECT * FROM ({_NEWS})"
    tok = tokens_sql("texts", "doc_id", "content")
    news = f"WITH texts AS MATERIALIZED ({_NEWS}), tok AS MATERIALIZED ({tok})"
    found = f"SELECT count(*) FROM (({_has('the')}) EXCEPT ({_has('forest')}))"

    def stored(configs: dict[str, IndexConfig]) -> str:
        names = _values([(k, ",".join(LAYOUTS[c.info])) for k, c in configs.items()], "name, columns")
        return f"{news} SELECT name, columns, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM tok)) AS postings, (SELECT count(*) FROM tok) AS positions, ({found}) AS found FROM ({names})"

    steps = [(0, "start", "", "0", "false"), (1, "created", "news,other", "n", "true"), (2, "removed", "news,other", "n - tens", "true"), (3, "again", "news,other", "n", "true"), (4, "deleted", "other", "0", "false")]
    counted = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS at, '{s}' AS step, '{names}' AS names, CAST({files} AS BIGINT) AS files, {size} AS has_size FROM c" for i, s, names, files, size in steps)
    words = {k: sorted({w for w in q.replace('"', " ").replace("(", " ").replace(")", " ").split()}) for k, q in MATCHES.items()}
    matched = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS query_id, doc_id, score FROM ({_ranked_sql(w, 'bm25')})" for k, w in words.items())
    early = ", early AS (SELECT term FROM (SELECT term, coalesce(sum(df) OVER (ORDER BY df, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS promised FROM df WHERE term IN ('glacier', 'forest', 'the')) WHERE promised < 10)"
    return {
        "query_trees": _values(list(TREES.items()), "query, tree"),
        "index_roundtrip": f"WITH texts AS ({union}), tok AS ({tok}) SELECT doc_id, 1.0::DOUBLE AS score FROM (({_has('the')}) EXCEPT ({_has('forest')}))",
        "index_lifecycle": f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id LIKE '%0') AS tens FROM ({_NEWS})) {counted}",
        "index_layouts": stored(LAYOUT_CONFIGS),
        "index_codecs": stored(CODEC_CONFIGS),
        "index_stores": stored(STORE_CONFIGS),
        "match_batch": matched,
        "query_file": f"SELECT CAST(query_id AS INTEGER) AS query_id, query, origin FROM ({_values([(i, q, 'file') for i, q in enumerate(SAMPLE)] + [(i, q, 'sample') for i, q in enumerate(corpus.SAMPLE_QUERIES)], 'query_id, query, origin')})",
        "results_file": "SELECT identifier, creation_time, disk_size_mb, avg_latency, p95_latency, p99_latency, throughput, memory_mb FROM (SELECT DISTINCT * FROM benchmark_results)",
        "benchmark_rows": "SELECT identifier, true AS made, true AS ordered, true AS has_throughput, true AS no_memory FROM (" + _values([("ESIndex_i3d2c1qTo0",), ("SelfIndex_i1d1c1qTo0",), ("SelfIndex_i3d1c1qDo0",)], "identifier") + ")",
        "early_stopping_top10": _ranked_sql(["glacier", "forest", "the"], "tfidf", "doc_id IN (SELECT doc_id FROM postings WHERE term IN (SELECT term FROM early))", 10, early),
        "thresholding_top100": f"SELECT * FROM ({_ranked_sql(['glacier', 'forest'], 'tfidf', cut=None)}) WHERE score >= 0.02 ORDER BY score DESC, doc_id LIMIT 100",
        "thresholding_boolean": "SELECT '' AS doc_id, 1.0::DOUBLE AS score WHERE false",
    }

