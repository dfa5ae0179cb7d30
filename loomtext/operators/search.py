"""Boolean, phrase and ranked retrieval over an index.

A query becomes one plan with one shuffle: postings of the query's terms, grouped by
document, with a presence flag or positions for each term, and the whole syntax tree as a
single predicate. The catalog is joined only if a document without any of the terms can
match. Many queries run as one plan too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyze import analyze_words
from ..plans.query import Node, Not, Phrase, Term, holds_without_terms, leaves, parse, predicate, rewrite, words_of
from .index import Index, idf, tf, with_lengths

TOP = 100
#: Fixed values of BM25.
K1, B = 1.2, 0.75


def compile_query(index: Index, query: str, analyze_query: bool = True) -> Node:
    """The tree over index terms. Without analysis words are only put in lower case."""
    tree = parse(query)
    words = words_of(tree)
    if not words:
        return rewrite(tree, {})
    lower = {w: [w.lower()] for w in words}
    if not analyze_query:
        return rewrite(tree, lower)
    return rewrite(tree, analyze_words(index.postings.sparkSession, words, index.analyzer))


def _terms(tree: Node) -> tuple[list[str], set[str]]:
    """All terms of a tree, and those in phrases."""
    words = words_of(tree)
    placed = {w for leaf in leaves(tree) if isinstance(leaf, Phrase) for w in leaf.words}
    return words, placed


def _none(index: Index) -> DataFrame:
    return index.doc_catalog.select("doc_id").where(F.lit(False))


def matching(index: Index, tree: Node) -> DataFrame:
    """Distinct ``doc_id`` for which the tree holds."""
    words, placed = _terms(tree)
    all_docs = holds_without_terms(tree)
    if not words:
        return index.doc_catalog.select("doc_id").distinct() if all_docs else _none(index)
    columns = ["term", "doc_id"] + (["positions"] if placed else [])
    hits = index.postings.where(F.col("term").isin(words)).select(columns)
    flags = [F.max(F.col("term") == w).alias(f"f{i}") for i, w in enumerate(words)]
    spots = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words) if w in placed]
    seen = hits.groupBy("doc_id").agg(*flags, *spots)
    if all_docs:
        seen = index.doc_catalog.select("doc_id").distinct().join(seen, "doc_id", "left")
    at = {w: i for i, w in enumerate(words)}
    flag = lambda w: F.coalesce(F.col(f"f{at[w]}"), F.lit(False))
    return seen.where(predicate(tree, flag, lambda w: F.col(f"p{at[w]}"))).select("doc_id")


def top(scored: DataFrame, n: int = TOP) -> DataFrame:
    """The best ``n``: by score, then by id."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(n)


def boolean_search(index: Index, query: str, analyze_query: bool = True, n: int | None = TOP, least_score: float | None = None, early: bool = False) -> DataFrame:
    """Documents of a Boolean query, all with score 1.

    ``least_score`` drops lower scores. ``early`` stops at the first ``n`` documents that are
    found, whichever they are, instead of ordering all.
    """
    found = matching(index, compile_query(index, query, analyze_query)).withColumn("score", F.lit(1.0))
    if least_score is not None:
        found = found.where(F.col("score") >= least_score)
    return found if n is None else found.limit(n) if early else top(found, n)


def rarest_terms(index: Index, words: list[str], n: int) -> list[str]:
    """The rarest of some terms that together have at least ``n`` postings, all of them if they have fewer."""
    known = index.term_stats.where(F.col("term").isin(words)).orderBy("df", "term").collect()  # one row for each query term
    out, promised = [], 0
    for r in known:
        if promised >= n:
            break
        out.append(r["term"])
        promised += r["df"]
    return out


def _scores(index: Index, words: list[str], weight: str, among: list[str] | None = None) -> DataFrame:
    """``doc_id`` and the sum of the weights of some terms, to 6 decimals; only documents with a term of ``among``."""
    hits = index.postings.where(F.col("term").isin(words))
    if weight in ("tfidf", "bm25"):
        hits = with_lengths(index, hits).select("term", "doc_id", "term_count", "doc_len")
    if weight == "boolean":
        value = F.lit(1.0)
    elif weight == "wordcount":
        value = F.col("term_count").cast("double")
    elif weight in ("tfidf", "bm25"):
        n, mean = index.size
        # one row for each query term
        hits = hits.join(F.broadcast(index.term_stats.where(F.col("term").isin(words))), "term")
        if weight == "tfidf":
            value = tf(F.col("term_count"), F.col("doc_len")) * idf(F.col("df"), n)
        else:
            value = bm25(F.col("term_count"), F.col("df"), F.col("doc_len"), n, mean)
    else:
        raise ValueError(f"unknown weight {weight}")
    sums = [F.round(F.sum(value), 6).alias("score")]
    if among is None:
        return hits.groupBy("doc_id").agg(*sums)
    return hits.groupBy("doc_id").agg(*sums, F.max(F.col("term").isin(among)).alias("_among")).where("_among").drop("_among")


def bm25(count: Column, df: Column, length: Column, n: int, mean: float) -> Column:
    rarity = F.ln(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return rarity * count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def ranked_search(index: Index, query: str, weight: str = "tfidf", ranked: str = "bag", analyze_query: bool = True, n: int | None = TOP, least_score: float | None = None, early: bool = False) -> DataFrame:
    """Documents by the sum of their weights.

    ``bag`` scores every document that has any term outside phrases, whatever the operators
    say; ``filtered`` keeps the documents of the Boolean query and scores the terms, phrases
    included, that are not under a NOT. ``least_score`` drops lower scores. ``early``, for a
    bag and with ``n``, scores only documents that have one of the rarest terms, so many of
    them that ``n`` postings are certain; their scores are whole.
    """
    tree = compile_query(index, query, analyze_query)
    if ranked == "bag":
        words = list(dict.fromkeys(leaf.word for leaf in leaves(tree) if isinstance(leaf, Term) and leaf.word))
        scored = _scores(index, words, weight, rarest_terms(index, words, n) if early and n else None)
    elif ranked == "filtered":
        words = [w for leaf in leaves(tree, True) for w in ([leaf.word] if isinstance(leaf, Term) else leaf.words) if w]
        scored = matching(index, tree).join(_scores(index, list(dict.fromkeys(words)), weight), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    else:
        raise ValueError(f"unknown ranking {ranked}")
    if least_score is not None:
        scored = scored.where(F.col("score") >= least_score)
    return scored if n is None else top(scored, n)


def match_batch(index: Index, queries: DataFrame, n: int = TOP) -> DataFrame:
    """``query_id``, ``doc_id`` and BM25 ``score`` of many match queries in one plan, the best ``n`` of each.

    The queries, a workload that fits the driver, are analyzed there. Postings of all their
    terms are read once and joined with a table of one row for each query and term.
    """
    rows = queries.select("query_id", "query").collect()
    plain = {r["query_id"]: (r["query"] or "").replace('"', " ").replace("(", " ").replace(")", " ").split() for r in rows}
    found = analyze_words(index.postings.sparkSession, list(dict.fromkeys(w for words in plain.values() for w in words)), index.analyzer)
    asked = sorted({(k, t) for k, words in plain.items() for w in words for t in found[w]})
    pairs = index.postings.sparkSession.createDataFrame(asked, f"query_id {queries.schema['query_id'].dataType.simpleString()}, term string")
    terms = sorted({t for _, t in asked})
    hits = with_lengths(index, index.postings.where(F.col("term").isin(terms))).select("term", "doc_id", "term_count", "doc_len")
    # a row for each query and term
    asked_df = pairs.join(index.term_stats.where(F.col("term").isin(terms)), "term")
    total, mean = index.size
    scored = hits.join(F.broadcast(asked_df), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(bm25(F.col("term_count"), F.col("df"), F.col("doc_len"), total, mean)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def match_search(index: Index, query: str, n: int = TOP) -> DataFrame:
    """BM25 of all words of a query, as plain text: quotes are dropped, operators are words like others."""
    words = query.replace('"', " ").replace("(", " ").replace(")", " ").split()
    found = analyze_words(index.postings.sparkSession, words, index.analyzer)
    return top(_scores(index, list(dict.fromkeys(t for w in words for t in found[w])), "bm25"), n)


@dataclass(frozen=True)
class _Leaf:
    query: int
    leaf: int
    words: tuple[str, ...]


def batch_search(index: Index, queries: DataFrame, analyze_query: bool = True, n: int | None = TOP) -> DataFrame:
    """``query_id``, ``doc_id`` and ``score`` of many Boolean queries in one plan.

    The queries, a workload that fits the driver, are parsed there. Their distinct words are
    read from the postings once and grouped by document; each document then tests all trees.
    """
    rows = queries.select("query_id", "query").orderBy("query_id").collect()
    trees = {r["query_id"]: parse(r["query"] or "") for r in rows}
    words = list(dict.fromkeys(w for t in trees.values() for w in words_of(t)))
    if analyze_query:
        terms = analyze_words(index.postings.sparkSession, words, index.analyzer)
    else:
        terms = {w: [w.lower()] for w in words}
    trees = {k: rewrite(t, terms) for k, t in trees.items()}
    used = sorted({w for t in trees.values() for w in words_of(t)})
    hits = index.postings.where(F.col("term").isin(used)).select("term", "doc_id", "positions")
    seen = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    if any(holds_without_terms(t) for t in trees.values()):
        seen = index.doc_catalog.select("doc_id").distinct().join(seen, "doc_id", "left")
    flag = lambda w: F.coalesce(F.map_contains_key("m", F.lit(w)), F.lit(False))
    spots = lambda w: F.try_element_at("m", F.lit(w))
    if not trees:
        return _none(index).select(F.lit(0).alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    tests = F.array(*(F.when(predicate(t, flag, spots), F.lit(k)) for k, t in trees.items()))
    found = seen.select(F.explode(F.filter(tests, lambda k: k.isNotNull())).alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    if n is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def results_json(results: DataFrame, n: int = TOP) -> DataFrame:
    """The best ``n`` results as one JSON array in the column ``json``, best first."""
    results = top(results, n)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "score")))
    return results.agg(F.to_json(F.transform(best, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score")))).alias("json"))


def any_of(words: list[str]) -> str:
    """A query for any of some words."""
    return reduce(lambda a, b: f'{a} OR "{b}"', words[1:], f'"{words[0]}"') if words else ""
