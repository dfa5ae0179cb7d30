"""Command line: word frequencies, an index with a query, the benchmark, and reports on stored results.

    python -m loomtext words --docs DOCS.parquet
    python -m loomtext index --docs DOCS.parquet --root ROOT --id ID
    python -m loomtext query --root ROOT --id ID '"forest" AND NOT "river"'
    python -m loomtext benchmark --docs DOCS.parquet --root ROOT [--queries QUERIES.json]
    python -m loomtext reports --results RESULTS.json --root ROOT
    python -m loomtext all --docs DOCS.parquet --root ROOT [--queries QUERIES.json]

Reports are written below ROOT/reports, one folder of CSV for each chart. ``all`` takes words,
benchmark and reports in turn; a step that fails is reported and the next one taken. DOCS has the columns ``doc_id`` and ``text`` or ``content``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import SearchEngine
from .operators import measure, report
from .queries import CHARTS, chart_frame
from .ship import ship
from .sources import corpus


def words(docs: DataFrame) -> None:
    for clean in (False, True):
        report.top_words(report.word_frequency(docs, clean)).show(30, truncate=False)


def benchmark(spark: SparkSession, docs: DataFrame, root: str, path: str | None) -> str:
    """Run the benchmark; where its results are."""
    queries = [r["query"] for r in corpus.read_queries(spark, path).orderBy("query_id").collect()]
    measure.write_results(measure.run_benchmark(spark, root, docs, queries), f"{root}/results")
    return f"{root}/results"


def reports(results: DataFrame, root: str) -> None:
    """Write the data behind each chart of a results file."""
    numbered = results.withColumn("run_at", F.monotonically_increasing_id())  # the order of the file
    frames = {name: chart_frame(numbered, name) for name in CHARTS}
    frames |= {f"axis_{a}": report.axis_report(numbered, a) for a in report.AXES}
    frames |= {"axis_means": report.axis_means(numbered), "fastest": report.fastest(numbered), "summary": report.first_rows(numbered)}
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/reports/{name}")
    frames["axis_means"].show(100, truncate=False)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("step", choices=["words", "index", "query", "benchmark", "reports", "all"])
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--docs")
    p.add_argument("--root", default="indexes")
    p.add_argument("--id", default="main")
    p.add_argument("--queries")
    p.add_argument("--results")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    ship(spark)

    def docs() -> DataFrame:
        if not a.docs:
            p.error("--docs is needed")
        raw = spark.read.parquet(a.docs)
        return raw.select("doc_id", F.col("content" if "content" in raw.columns else "text").alias("content"))

    def stored() -> DataFrame:
        return corpus.read_results(spark, a.results or f"{a.root}/results")

    steps = {
        "words": lambda: words(docs()),
        "index": lambda: SearchEngine(spark, a.root).create_index(a.id, docs()),
        "benchmark": lambda: benchmark(spark, docs(), a.root, a.queries),
        "reports": lambda: reports(stored(), a.root),
    }
    if a.step == "query":
        engine = SearchEngine(spark, a.root)
        engine.load_index(a.id)
        print(engine.query(a.query))
    elif a.step == "all":
        for name in ("words", "benchmark", "reports"):
            try:
                steps[name]()
            except Exception as e:
                print(f"{name}: {type(e).__name__}: {e}")
    else:
        steps[a.step]()


if __name__ == "__main__":
    main()
