"""Registered queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .functions.analyze import CLEAN, RAW, Analyzer, positions, tokens_sql
from .functions.porter import stem_sql, stem_words
from .operators import index as ix
from .operators import report, search, skew
from .sources import corpus

Query = Callable[[SparkSession, str], DataFrame]

#: Boolean queries over the documents: one or two of each kind of shape.
BOOLEAN = {
    "term_lookup": '"judge"',
    "and_query": '"judge" AND "court"',
    "or_query": '"glacier" OR "forest"',
    "or3_query": '"treasury" OR "senator" OR "violin"',
    "not_query": 'NOT "the"',
    "and_not_query": '"forest" AND NOT "glacier"',
    "nested_query": '("forest" OR "river") AND "glacier" AND NOT "storm"',
    "nested_or_query": '("judge" AND "court") OR ("team" AND "league")',
    "phrase2": '"grew by"',
    "phrase3": '"such as the"',
    "phrase_repeated": '"the end of the"',
    "phrase_and_term": '"more than" AND "forest"',
    "phrase_and_or": '"might never have" AND ("judge" OR "forest")',
    "phrase_and_not": '"forest" AND NOT "counts more"',
    "unknown_term": '"qqqqqq"',
    "empty_query": "nothing is quoted here",
}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))


_indexes: dict[tuple, ix.Index] = {}


def _index(spark: SparkSession, sf: str, analyzer: Analyzer = RAW) -> ix.Index:
    """The index of the documents, built once for each session, folder and analyzer and kept as durable tables."""
    key = (spark.sparkContext.applicationId, sf, analyzer)
    if key not in _indexes:
        ordered = {"postings": ["term", "doc_id"], "term_stats": ["term"], "doc_catalog": ["doc_id"]}
        keep = lambda df, table: durable(df.repartitionByRange(*ordered[table]).sortWithinPartitions(*ordered[table]), table, kept=True)
        _indexes[key] = ix.build(_docs(spark, sf), analyzer).stored(keep)
    return _indexes[key]


def _boolean(query: str) -> Query:
    return lambda spark, sf: search.boolean_search(_index(spark, sf), query, n=None)


def _positions_text(df: DataFrame) -> DataFrame:
    return df.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


# Text analysis


def tokenize_positions(spark: SparkSession, sf: str) -> DataFrame:
    return positions(_docs(spark, sf), RAW)


def stopword_filtered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return positions(_docs(spark, sf), Analyzer(True, False))


def porter_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return stem_words(positions(_docs(spark, sf), RAW).select("term").distinct())


def porter_1980_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return stem_words(positions(_docs(spark, sf), RAW).select("term").distinct(), extended=False)


def preprocess_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return positions(_docs(spark, sf), CLEAN)


def word_freq_raw_top30(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_words(report.word_frequency(_docs(spark, sf)))


def word_freq_clean_top30(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_words(report.word_frequency(_docs(spark, sf), clean=True))


def vocabulary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    raw, clean = (report.word_frequency(_docs(spark, sf), c).agg(F.count(F.lit(1)).alias("distinct_terms"), F.sum("n").alias("terms")) for c in (False, True))
    return raw.select(F.lit("raw").alias("stage"), "*").unionByName(clean.select(F.lit("clean").alias("stage"), "*"))


# Sources


def load_wikipedia(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pages(_table(spark, sf, "wikipedia"))


def load_news(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.news(_table(spark, sf, "news_files"))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.all_documents(_table(spark, sf, "wikipedia"), _table(spark, sf, "news_files"))


def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sample(union_sources(spark, sf), 100)


# The index


def postings_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return _positions_text(_index(spark, sf).postings.select("term", "doc_id", "positions"))


def postings_wordcount(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).postings.select("term", "doc_id", "term_count")


def postings_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return ix.weights(_index(spark, sf)).select("term", "doc_id", F.round("tf", 6).alias("tf"), F.round("tfidf", 6).alias("tfidf"))


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).doc_catalog


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).term_stats


def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return index.term_stats.select("term", F.round(ix.idf(F.col("df"), index.size[0]), 6).alias("idf"))


def list_indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    return ix.indexed_files(_index(spark, sf))


def skip_pointers(spark: SparkSession, sf: str) -> DataFrame:
    return ix.skip_targets(_index(spark, sf).postings.select("term", "doc_id"))


def doc_gaps(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return ix.doc_gaps(index.postings, index.doc_catalog)


def vbyte_size_model(spark: SparkSession, sf: str) -> DataFrame:
    return ix.vbyte_sizes(doc_gaps(spark, sf))


def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """German documents go, all pages come; the weights of the index after that."""
    gone = _table(spark, sf, "documents").where("lang = 'de'").select("doc_id")
    after = ix.changed(_index(spark, sf), gone, load_wikipedia(spark, sf))
    return after.term_stats.select("term", "df", F.round(ix.idf(F.col("df"), after.size[0]), 6).alias("idf"))


# Retrieval


def boolean_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.boolean_search(_index(spark, sf), '("forest" OR "judge") AND NOT "glacier"')


def results_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return search.results_json(boolean_top100(spark, sf))


def stemmed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Query words are analyzed like the text, so other forms of a word match."""
    return search.boolean_search(_index(spark, sf, CLEAN), '"forests" OR "state of the glaciers"', n=None)


def stemmed_query_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Query words are only put in lower case, so a word whose stem differs matches nothing."""
    return search.boolean_search(_index(spark, sf, CLEAN), '"vaccines" OR "forest"', analyze_query=False, n=None)


def daat_tfidf_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(_index(spark, sf), '"forest" OR "glacier"')


def daat_wordcount_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(_index(spark, sf), '"forest" OR "glacier"', "wordcount")


def daat_boolean_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(_index(spark, sf), '"forest" OR "glacier"', "boolean")


def daat_ignores_not(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(_index(spark, sf), '"forest" AND NOT "glacier" AND "more than"')


def ranked_filtered_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(_index(spark, sf), '"forest" AND NOT "glacier"', ranked="filtered")


def bm25_match_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.match_search(_index(spark, sf), '"forest glacier" river')


def batch_workload(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(BOOLEAN.values())), "query_id int, query string")
    return search.batch_search(_index(spark, sf), rows, n=None).select("query_id", "doc_id")


# Reports on benchmark results


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark_results").distinct()


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return report.percentiles(_table(spark, sf, "events"), "event_type", "value")


def event_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return report.throughput(_table(spark, sf, "events"), "event_type", "value")


def axis_means(spark: SparkSession, sf: str) -> DataFrame:
    return report.axis_means(_results(spark, sf))


def _axis(axis: str) -> Query:
    return lambda spark, sf: report.axis_report(_results(spark, sf), axis)


def compression_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return report.baseline_ratio(_results(spark, sf), "compr", "disk_size_mb", "1")


def optimization_speedup(spark: SparkSession, sf: str) -> DataFrame:
    return report.baseline_ratio(_results(spark, sf), "optim", "avg_latency", "0")


def _histogram(value: str) -> Query:
    return lambda spark, sf: report.histogram(_results(spark, sf), value)


def top10_configs(spark: SparkSession, sf: str) -> DataFrame:
    return report.fastest(_results(spark, sf))


def summary_first6(spark: SparkSession, sf: str) -> DataFrame:
    return report.first_rows(_results(spark, sf))


def latency_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs behind the scatter charts."""
    return _results(spark, sf).select("identifier", "run_at", "disk_size_mb", "creation_time", "avg_latency", "throughput")


def _size_column() -> list:
    return [F.col("disk_size_mb")]


def _latency_columns(*more: str) -> list:
    return [report.milliseconds("p95_latency").alias("p95_ms"), *(F.col(c) for c in more)]


# The charts' axes and labels; their columns, and the core if only one counts.
CHARTS = {
    "chart_index_types": ("info", {"1": "Boolean (x=1)", "2": "WordCount (x=2)", "3": "TF-IDF (x=3)"}, _size_column, None),
    "chart_datastores": ("dstore", {"1": "Custom (y=1)", "2": "DB1 (y=2)", "3": "DB2 (y=3)"}, _latency_columns, "SelfIndex"),
    "chart_compression": ("compr", {"1": "None (z=1)", "2": "VByte (z=2)", "3": "Zlib (z=3)"}, lambda: _latency_columns("throughput"), None),
    "chart_optimization": ("optim", {"0": "No Skip (i=0)", "sp": "Skip Pointers (i=1)"}, _latency_columns, None),
    "chart_query_processing": ("qproc", {"T": "TAAT (q=T)", "D": "DAAT (q=D)"}, lambda: _latency_columns("memory_mb"), None),
}


def chart_frame(results: DataFrame, name: str) -> DataFrame:
    axis, labels, columns, core = CHARTS[name]
    return report.chart(results, axis, labels, columns(), core, 3 if core else 0)


def _chart(name: str) -> Query:
    return lambda spark, sf: chart_frame(_results(spark, sf), name)


# Uneven keys


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_terms(spark, sf).where("heavy").select("term")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return skew.term_results(_table(spark, sf, "inverted_index"))


_PLAIN = (
    tokenize_positions, stopword_filtered_tokens, porter_vocabulary, porter_1980_vocabulary, preprocess_tokens,
    word_freq_raw_top30, word_freq_clean_top30, vocabulary_sizes, load_wikipedia, load_news, union_sources,
    sample_documents, postings_boolean, postings_wordcount, postings_tfidf, doc_lengths, document_frequency, idf_table,
    list_indexed_files, skip_pointers, doc_gaps, vbyte_size_model, index_update, boolean_top100,
    results_as_json, stemmed_query, stemmed_query_compat, daat_tfidf_top100, daat_wordcount_top100,
    daat_boolean_top100, daat_ignores_not, ranked_filtered_top100, bm25_match_top100, batch_workload,
    latency_percentiles, event_throughput, axis_means, compression_ratio, optimization_speedup, top10_configs,
    summary_first6, latency_pairs, p2_found, p2_terms,
)
HISTOGRAMS = {"size_histogram": "disk_size_mb", "latency_histogram": "avg_latency", "throughput_histogram": "throughput"}


def queries() -> dict[str, Query]:
    out = {f.__name__: f for f in _PLAIN}
    out |= {name: _boolean(q) for name, q in BOOLEAN.items()}
    out |= {f"axis_{a}": _axis(a) for a in report.AXES}
    out |= {name: _histogram(v) for name, v in HISTOGRAMS.items()}
    out |= {name: _chart(name) for name in CHARTS}
    return out | _stored().queries()


def _stored():
    from . import stored_queries  # it uses this module

    return stored_queries


# SQL for DuckDB

_TOK = tokens_sql("documents", "doc_id", "text")
_STOPPED = tokens_sql("documents", "doc_id", "text", stop_words=True)
_SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INDEX = f"""
tok AS MATERIALIZED ({_TOK}),
postings AS (SELECT term, doc_id, count(*) AS n FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
catalog AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(any_value(t.n), 0) AS len
            FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) t ON t.doc_id = CAST(d.doc_id AS VARCHAR) GROUP BY 1),
total AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM catalog)"""
_STEMMED = f"""
stopped AS MATERIALIZED ({_STOPPED}),
vocabulary AS (SELECT DISTINCT term FROM stopped),
stems AS ({stem_sql("vocabulary")}),
clean AS MATERIALIZED (SELECT doc_id, pos, stem AS term FROM stopped JOIN stems USING (term))"""


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_PAGES = f"""
SELECT doc_id, content FROM (
    SELECT 'wiki_' || id AS doc_id, arg_max(content, (coalesce(revised_at, TIMESTAMP '0001-01-01'), coalesce(loaded_at, TIMESTAMP '0001-01-01'), content)) AS content
    FROM (SELECT id, revised_at, loaded_at, {_strip_sql("coalesce(title, '') || ' ' || coalesce(text, '')")} AS content FROM wikipedia WHERE id IS NOT NULL) GROUP BY 1)
WHERE content <> ''"""
_NEWS = f"""
SELECT 'news_' || (row_number() OVER (ORDER BY path) - 1) AS doc_id, content FROM (
    SELECT path, {_strip_sql("coalesce(json_extract_string(body, '$.title'), '') || ' ' || coalesce(json_extract_string(body, '$.text'), '')")} AS content
    FROM (SELECT path, arg_max(body, (loaded_at, body)) AS body FROM news_files WHERE path IS NOT NULL AND body IS NOT NULL GROUP BY path)
    WHERE json_valid(body) AND json_type(body) = 'OBJECT')
WHERE content <> ''"""


def _has(word: str) -> str:
    return f"SELECT doc_id FROM tok WHERE term = '{word}'"


def _phrase(words: str) -> str:
    first, *rest = words.split()
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(rest, 1))
    return f"SELECT t0.doc_id FROM tok t0 {joins} WHERE t0.term = '{first}'"


_ALL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents"
_BOOLEAN_SQL = {
    "term_lookup": _has("judge"),
    "and_query": f"{_has('judge')} INTERSECT {_has('court')}",
    "or_query": f"{_has('glacier')} UNION {_has('forest')}",
    "or3_query": f"{_has('treasury')} UNION {_has('senator')} UNION {_has('violin')}",
    "not_query": f"{_ALL} EXCEPT {_has('the')}",
    "and_not_query": f"{_has('forest')} EXCEPT {_has('glacier')}",
    "nested_query": f"((({_has('forest')}) UNION ({_has('river')})) INTERSECT ({_has('glacier')})) EXCEPT ({_has('storm')})",
    "nested_or_query": f"(({_has('judge')}) INTERSECT ({_has('court')})) UNION (({_has('team')}) INTERSECT ({_has('league')}))",
    "phrase2": _phrase("grew by"),
    "phrase3": _phrase("such as the"),
    "phrase_repeated": _phrase("the end of the"),
    "phrase_and_term": f"({_phrase('more than')}) INTERSECT ({_has('forest')})",
    "phrase_and_or": f"({_phrase('might never have')}) INTERSECT (({_has('judge')}) UNION ({_has('forest')}))",
    "phrase_and_not": f"({_has('forest')}) EXCEPT ({_phrase('counts more')})",
    "unknown_term": _has("qqqqqq"),
    "empty_query": f"{_ALL} WHERE false",
}


def _ranked_sql(words: list[str], weight: str, where: str = "true", cut: int | None = 100, more: str = "") -> str:
    terms = ", ".join(f"'{w}'" for w in words)
    value = {
        "boolean": "1.0::DOUBLE",
        "wordcount": "n::DOUBLE",
        "tfidf": "n::DOUBLE / len * ln(n_docs::DOUBLE / df)",
        "bm25": "ln(1 + (n_docs::DOUBLE - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean_len))",
    }[weight]
    first = f" ORDER BY score DESC, doc_id LIMIT {cut}" if cut else ""
    return f"WITH {_INDEX}{more} SELECT doc_id, round(sum({value}), 6) AS score FROM postings JOIN df USING (term) JOIN catalog USING (doc_id), total WHERE term IN ({terms}) AND {where} GROUP BY doc_id{first}"


_RESULTS = """
results AS (
    SELECT DISTINCT *, regexp_extract(identifier, '^([^_]+)_i(\\d)d(\\d)c(\\d)q([TD])o(\\w+)$', ['core', 'info', 'dstore', 'compr', 'qproc', 'optim']) AS x
    FROM benchmark_results),
parsed AS (SELECT *, x.core AS core, x.info AS info, x.dstore AS dstore, x.compr AS compr, x.qproc AS qproc, x.optim AS optim FROM results WHERE x.core <> '')"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in report.METRICS)


def _means_sql(axis: str) -> str:
    return f"SELECT '{axis}' AS axis, {axis} AS value, count(*) AS configs, {_MEANS} FROM parsed GROUP BY {axis}"


def _label_sql(axis: str, names: dict[str, str]) -> str:
    return f"CASE {axis} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {axis} END"


def _histogram_sql(v: str) -> str:
    return f"""
        WITH r AS (SELECT DISTINCT * FROM benchmark_results), e AS (SELECT min({v}) AS lo, max({v}) AS hi FROM r),
        w AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, ((CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END) - (CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)) / 15 AS w FROM e),
        c AS (SELECT CAST(least(floor(({v} - lo) / w), 14) AS BIGINT) AS bin, count(*) AS n FROM r, w WHERE {v} IS NOT NULL GROUP BY 1)
        SELECT b.bin AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, coalesce(n, 0) AS n
        FROM w, (SELECT unnest(range(15)) AS bin) b LEFT JOIN c USING (bin)"""


def _chart_sql(name: str) -> str:
    axis, labels, _, core = CHARTS[name]
    columns = {"chart_index_types": "disk_size_mb", "chart_compression": "round(p95_latency * 1000, 6) AS p95_ms, throughput", "chart_query_processing": "round(p95_latency * 1000, 6) AS p95_ms, memory_mb"}.get(name, "round(p95_latency * 1000, 6) AS p95_ms")
    keys = ", ".join(f"'{k}'" for k in labels)
    return f"WITH {_RESULTS} SELECT identifier, {_label_sql(axis, labels)} AS label, {columns} FROM parsed WHERE {axis} IN ({keys})" + (f" AND core = '{core}'" if core else "")


def _ratio_sql(axis: str, metric: str, base: str) -> str:
    return f"WITH {_RESULTS}, m AS (SELECT {axis} AS value, round(avg({metric}), 6) AS mean FROM parsed GROUP BY 1) SELECT value, mean, CASE WHEN mean > 0 THEN round((SELECT mean FROM m WHERE value = '{base}') / mean, 6) ELSE 0 END AS ratio FROM m"


def oracle_sql() -> dict[str, str]:
    terms = """
        WITH rows AS (SELECT lower(trim(term, ' ')) AS term, doc_id, coalesce(len(postings), 0) AS held FROM inverted_index WHERE term IS NOT NULL),
        everything AS (SELECT count(*) AS n FROM rows)
        SELECT term, count(*) AS total_rows, count(DISTINCT doc_id) AS records, CAST(sum(held) AS BIGINT) AS positions,
               round(count(*)::DOUBLE / nullif(count(DISTINCT doc_id), 0), 6) AS per_record,
               round(count(*)::DOUBLE / any_value(n), 6) AS share, count(*) * 100 >= any_value(n) AS heavy
        FROM rows, everything GROUP BY term"""
    union = f"SELECT * FROM ({_PAGES}) UNION ALL SELECT * FROM ({_NEWS})"
    changed = f"""
        WITH kept AS (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'de'),
        texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM kept UNION ALL SELECT * FROM ({_PAGES})),
        tok AS ({tokens_sql("texts", "doc_id", "content")}), n AS (SELECT count(DISTINCT doc_id) AS n FROM texts)
        SELECT term, count(DISTINCT doc_id) AS df, round(ln(any_value(n)::DOUBLE / count(DISTINCT doc_id)), 6) AS idf FROM tok, n GROUP BY term"""
    vocabulary = f"WITH tok AS ({_TOK}), vocabulary AS (SELECT DISTINCT term FROM tok)"
    numbers = f"{_INDEX}, numbers AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM catalog)"
    gaps = f"SELECT term, doc_id, k - coalesce(lag(k) OVER (PARTITION BY term ORDER BY k), 0) AS gap FROM postings JOIN numbers USING (doc_id)"
    top = f"SELECT doc_id, 1.0::DOUBLE AS score FROM (({_has('forest')} UNION {_has('judge')}) EXCEPT {_has('glacier')}) ORDER BY doc_id LIMIT 100"
    clean_phrase = "SELECT a.doc_id FROM clean a JOIN clean b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.term = 'glacier' WHERE a.term = 'state'"
    means = " UNION ALL ".join(_means_sql(a) for a in report.AXES)
    out = {
        "tokenize_positions": _TOK,
        "stopword_filtered_tokens": _STOPPED,
        "porter_vocabulary": f"{vocabulary} {stem_sql('vocabulary')}",
        "porter_1980_vocabulary": f"{vocabulary} {stem_sql('vocabulary', extended=False)}",
        "preprocess_tokens": f"WITH {_STEMMED} SELECT doc_id, pos, term FROM clean",
        "word_freq_raw_top30": f"SELECT term, count(*) AS n FROM ({_TOK}) GROUP BY term ORDER BY n DESC, term LIMIT 30",
        "word_freq_clean_top30": f"WITH {_STEMMED} SELECT term, count(*) AS n FROM clean GROUP BY term ORDER BY n DESC, term LIMIT 30",
        "vocabulary_sizes": f"WITH {_STEMMED} SELECT 'raw' AS stage, count(DISTINCT term) AS distinct_terms, count(*) AS terms FROM ({_TOK}) UNION ALL SELECT 'clean', count(DISTINCT term), count(*) FROM clean",
        "load_wikipedia": _PAGES,
        "load_news": _NEWS,
        "union_sources": union,
        "sample_documents": f"SELECT * FROM ({union}) ORDER BY doc_id LIMIT 100",
        "postings_boolean": f"SELECT term, doc_id, string_agg(pos, ',' ORDER BY pos) AS positions FROM ({_TOK}) GROUP BY term, doc_id",
        "postings_wordcount": f"SELECT term, doc_id, CAST(count(*) AS INTEGER) AS term_count FROM ({_TOK}) GROUP BY term, doc_id",
        "postings_tfidf": f"WITH {_INDEX} SELECT term, doc_id, round(n::DOUBLE / len, 6) AS tf, round(n::DOUBLE / len * ln(n_docs::DOUBLE / df), 6) AS tfidf FROM postings JOIN df USING (term) JOIN catalog USING (doc_id), total",
        "doc_lengths": f"WITH {_INDEX} SELECT doc_id, CAST(len AS INTEGER) AS doc_len FROM catalog",
        "document_frequency": f"WITH {_INDEX} SELECT term, df FROM df",
        "idf_table": f"WITH {_INDEX} SELECT term, round(ln(n_docs::DOUBLE / df), 6) AS idf FROM df, total",
        "list_indexed_files": f"SELECT DISTINCT doc_id FROM ({_ALL}) ORDER BY doc_id",
        "skip_pointers": f"""
            WITH {_INDEX}, o AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS ordinal, count(*) OVER (PARTITION BY term) AS c FROM postings),
            s AS (SELECT *, ordinal + CAST(floor(sqrt(c)) AS BIGINT) AS k FROM o)
            SELECT term, doc_id, ordinal, CASE WHEN k < c THEN k END AS skip_to FROM s""",
        "doc_gaps": f"WITH {numbers} {gaps}",
        "vbyte_size_model": f"WITH {numbers} SELECT term, count(*) AS postings, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM ({gaps}) GROUP BY term",
        "index_update": changed,
        "boolean_top100": f"WITH tok AS ({_TOK}) {top}",
        "results_as_json": f"""WITH tok AS ({_TOK}), top AS ({top}) SELECT '[' || string_agg('{{"doc_id":"' || doc_id || '","score":1.0}}', ',' ORDER BY doc_id) || ']' AS json FROM top""",
        "stemmed_query": f"WITH {_STEMMED} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM (SELECT doc_id FROM clean WHERE term = 'forest' UNION {clean_phrase})",
        "stemmed_query_compat": f"WITH {_STEMMED} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM clean WHERE term IN ('vaccines', 'forest')",
        "daat_tfidf_top100": _ranked_sql(["forest", "glacier"], "tfidf"),
        "daat_wordcount_top100": _ranked_sql(["forest", "glacier"], "wordcount"),
        "daat_boolean_top100": _ranked_sql(["forest", "glacier"], "boolean"),
        "daat_ignores_not": _ranked_sql(["forest", "glacier"], "tfidf"),
        "ranked_filtered_top100": _ranked_sql(["forest"], "tfidf", f"doc_id NOT IN ({_has('glacier')})"),
        "bm25_match_top100": _ranked_sql(["forest", "glacier", "river"], "bm25"),
        "batch_workload": f"WITH tok AS ({_TOK}) " + " UNION ALL ".join(f"SELECT DISTINCT CAST({i} AS INTEGER) AS query_id, doc_id FROM ({_BOOLEAN_SQL[k]})" for i, k in enumerate(BOOLEAN)),
        "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
        "event_throughput": "SELECT event_type, count(value) AS n, round(CASE WHEN sum(value) > 0 THEN count(value) / sum(value) ELSE 0 END, 6) AS per_second FROM events GROUP BY event_type",
        "axis_means": f"WITH {_RESULTS} {means}",
        "compression_ratio": _ratio_sql("compr", "disk_size_mb", "1"),
        "optimization_speedup": _ratio_sql("optim", "avg_latency", "0"),
        "top10_configs": "SELECT replace(replace(identifier, 'SelfIndex_', ''), 'ESIndex_', 'ES_') AS name, avg_latency FROM (SELECT DISTINCT * FROM benchmark_results) WHERE avg_latency IS NOT NULL ORDER BY avg_latency, identifier, run_at LIMIT 10",
        "summary_first6": "SELECT left(identifier, 15) AS label, round(p95_latency * 1000, 6) AS p95_ms, throughput, disk_size_mb, memory_mb FROM (SELECT DISTINCT * FROM benchmark_results) ORDER BY run_at NULLS FIRST, identifier NULLS FIRST, avg_latency NULLS FIRST LIMIT 6",
        "latency_pairs": "SELECT DISTINCT identifier, run_at, disk_size_mb, creation_time, avg_latency, throughput FROM (SELECT DISTINCT * FROM benchmark_results)",
        "p2_found": f"SELECT term FROM ({terms}) WHERE heavy",
        "p2_terms": terms,
    }
    out |= {k: f"WITH tok AS ({_TOK}) SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM ({sql})" for k, sql in _BOOLEAN_SQL.items()}
    out |= {f"axis_{a}": f"WITH {_RESULTS} SELECT {_label_sql('value', report.NAMES[a])} AS label, configs, {', '.join(report.METRICS)} FROM ({_means_sql(a)})" for a in report.AXES}
    out |= {name: _histogram_sql(v) for name, v in HISTOGRAMS.items()}
    out |= {name: _chart_sql(name) for name in CHARTS}
    return out | _stored().oracle_sql()
