"""Sources of documents: encyclopedia pages, news files, their union, samples, query files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable

#: Queries used where no query file is given.
SAMPLE_QUERIES = ['"forest"', '"court" AND "judge"', '"river" OR "glacier"', '"team" AND NOT "league"', '"by the end of the year"']
NEWS_SCHEMA = "title string, text string, _corrupt_record string"


def strip(text: Column) -> Column:
    """Without white space, of any kind, at either end."""
    space = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return F.regexp_replace(text, rf"^{space}+|{space}+$", "")


def _content(title: Column, text: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def pages(raw: DataFrame, most: int | None = None) -> DataFrame:
    """``doc_id`` and ``content`` of encyclopedia pages ``id``, ``title``, ``text``.

    Pages without content and without an id are left out. With ``revised_at`` the latest
    revision of an id counts, then the one loaded last, then the greater content; without,
    rows stay as they are. ``most`` keeps the first pages by id.
    """
    order = [F.col(c) for c in ("revised_at", "loaded_at") if c in raw.columns]
    rows = raw.where("id is not null").select(F.concat(F.lit("wiki_"), F.col("id").cast("string")).alias("doc_id"), _content(F.col("title"), F.col("text")).alias("content"), *order)
    if order:
        rows = rows.groupBy("doc_id").agg(F.max_by("content", F.struct(*order, "content")).alias("content"))
    out = rows.select("doc_id", "content").where("content <> ''")
    return out.orderBy("doc_id").limit(most) if most else out


def read_news(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``body`` of all ``*.json`` files below a folder; an absent folder has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, body string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("ignoreCorruptFiles", True).format("binaryFile").load(folder)
    return files.select("path", F.col("content").cast("string").alias("body"))


def news(files: DataFrame) -> DataFrame:
    """``doc_id`` and ``content`` of news files ``path``, ``body`` of one JSON object each.

    A file that cannot be parsed and one without content is skipped. The n-th file kept, by
    path from 0, is ``news_n``. A path delivered twice counts once, the last (``loaded_at``)
    or else the greater body. A missing or null title or text is empty.
    """
    order = [F.col(c) for c in ("loaded_at",) if c in files.columns]
    once = files.where("path is not null").groupBy("path").agg(F.max_by("body", F.struct(*order, "body")).alias("body"))
    parsed = once.select("path", F.from_json("body", NEWS_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    rows = parsed.where("j is not null and j._corrupt_record is null").select("path", _content(F.col("j.title"), F.col("j.text")).alias("content")).where("content <> ''")
    return numbered(rows, "path").select(F.concat(F.lit("news_"), F.col("ordinal").cast("string")).alias("doc_id"), "content")


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``ordinal``, from 0 in the order of the columns ``by``, together unique.

    Sorted by range and numbered within each partition, so no task sees all rows. The counts,
    one for each partition, are all that is gathered.
    """
    local = F.monotonically_increasing_id()  # partition << 33 | position
    placed = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", local), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("ordinal", own + F.col("_before")).drop("_part", "_before", "_at")


def all_documents(wiki: DataFrame | None, files: DataFrame | None, most_pages: int | None = None) -> DataFrame:
    """Pages, then news, as one source; either may be absent."""
    parts = [pages(wiki, most_pages)] if wiki is not None else []
    parts += [news(files)] if files is not None else []
    if not parts:
        raise ValueError("no source was given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sample(docs: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` documents by id."""
    return docs.orderBy("doc_id").limit(n)


def read_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``query_id`` from 0 and ``query`` of a JSON array of strings; sample queries without a file."""
    queries = SAMPLE_QUERIES
    if path:
        text = spark.read.text(path, wholetext=True).first()
        queries = json.loads(text[0]) if text else []
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def write_sample_queries(path: str) -> None:
    """Write the sample queries to a local file if it doesn't exist."""
    try:
        with open(path, "x") as f:
            json.dump(SAMPLE_QUERIES, f, indent=2)
    except FileExistsError:
        pass


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of a JSON list."""
    from ..operators.measure import RESULT_SCHEMA

    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
