"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, distinct, frequency, leakage, neardup, packing, subjects
from .codepoints import VISIBLE

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_shares(spark, sf).select("origin", "rec_id", "subject")


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    names = ("documents", "wikipedia", "subject_labels", "subject_areas")
    return subjects.subject_areas(*(_table(spark, sf, n) for n in names))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = neardup.near_duplicates(_table(spark, sf, "documents"), shingle=3, similarity=0.5)
    return neardup.duplicate_pairs(links, members)


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    links, members = neardup.near_duplicates(_table(spark, sf, "documents"), short=True)
    return neardup.groups(links, members)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.top_terms(p4_scores(spark, sf))


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.characteristic_terms(_table(spark, sf, "inverted_index"), _table(spark, sf, "doc_catalog"))


def p4_elite(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.elite_terms(p4_scores(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_terms(spark, sf).where("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.index_frequencies(_table(spark, sf, "inverted_index"), _table(spark, sf, "doc_catalog"))


def p5_words(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.text_frequencies(_table(spark, sf, "documents"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pack(spark, sf).where("pieces > 1 and piece = 0").select("doc_id")


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """How each text is cut, wherever its pieces lie."""
    return p6_pack(spark, sf).drop("container")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Whether no container holds too much, and little room is left in all but the last few."""
    used = p6_pack(spark, sf).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    told = used.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used") <= 1024, F.lit(True)).alias("none_too_full"), F.coalesce(F.sum("used") >= 0.95 * 1024 * (F.count(F.lit(1)) - 8), F.lit(True)).alias("well_filled"))
    return told


def p6_vocabulary_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in tokens of a public vocabulary, whose folder LOOMTEXT_TOKENIZERS names."""
    folder = os.environ.get("LOOMTEXT_TOKENIZERS", "/opt/tokenizers")
    return packing.pack(_table(spark, sf, "documents"), tokens=packing.vocabulary_tokens(f"{folder}/byte_bpe_50k.json"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on the words as they are written, without one form for look-alikes."""
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), unified=False).select("doc_id", "item_id", "words")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_form(_table(spark, sf, "documents")).where("kinds > 0").select("doc_id")


def p8_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_form(_table(spark, sf, "documents"))


def p8_invisible(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with invisible characters or with spaces other than the plain one."""
    kinds = F.col("kinds")
    found = canonical.canonical_form(_table(spark, sf, "documents")).select("doc_id", (kinds.bitwiseAND(canonical.INVISIBLE) > 0).alias("invisible"), (kinds.bitwiseAND(canonical.SPACE) > 0).alias("other_space"))
    return found.where("invisible or other_space")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_shares": p1_shares, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_scores": p4_scores, "p4_elite": p4_elite, "p5_found": p5_found, "p5_terms": p5_terms, "p5_words": p5_words, "p6_found": p6_found, "p6_pack": p6_pack, "p6_pieces": p6_pieces, "p6_fill": p6_fill, "p6_vocabulary_pack": p6_vocabulary_pack, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_plain": p7_plain, "p8_found": p8_found, "p8_canonical": p8_canonical, "p8_invisible": p8_invisible}


_INDEX = """
rows AS (
    SELECT term, doc_id, arg_max(struct_pack(c := term_count), (written_at, coalesce(term_count, -1))) AS v
    FROM (SELECT lower(trim(term, ' ')) AS term, doc_id, term_count, written_at FROM inverted_index)
    WHERE term <> '__all_docs__' AND doc_id IS NOT NULL
    GROUP BY ALL),
counts AS (
    SELECT term, CAST(sum(coalesce(v.c, 0)) AS BIGINT) AS occurrences, count(*) AS records
    FROM rows GROUP BY term),
size AS (SELECT count(DISTINCT doc_id) AS n FROM doc_catalog)"""

_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END"

#: The two-Poisson mixture of each term, 50 rounds of expectation-maximisation over its histogram as lists.
_MIXTURES = f"""
{_INDEX},
bars AS (SELECT term, coalesce(v.c, 0)::DOUBLE AS k, count(*)::DOUBLE AS t FROM rows GROUP BY ALL),
zeros AS (SELECT term, 0::DOUBLE AS k, greatest(n - records, 0)::DOUBLE AS t FROM counts, size),
h AS (
    SELECT term, list({{'k': k, 't': t}} ORDER BY k) AS bars, sum(t) AS total, sum(t * k) AS hits, sum(t) FILTER (k > 0) AS positive
    FROM (SELECT * FROM bars UNION ALL SELECT * FROM zeros) GROUP BY term HAVING sum(t * k) > 0),
em AS (
    SELECT term, 0 AS i, greatest(least(positive / total / 2, 0.5), 1e-12) AS share, greatest(hits / positive, hits / total) + 0.5 AS high, greatest(hits / total / 4, 1e-12) AS low FROM h
    UNION ALL
    SELECT term, i + 1, greatest(least(n / total, 1 - 1e-9), 1e-12), greatest(found / greatest(n, 1e-300), 1e-12), greatest((hits - found) / greatest(total - n, 1e-9), 1e-12)
    FROM (
        SELECT term, i, total, hits, list_sum(list_transform(e, lambda x: x.n)) AS n, list_sum(list_transform(e, lambda x: x.n * x.k)) AS found
        FROM (
            SELECT term, i, total, hits, list_transform(bars, lambda x: {{'k': x.k, 'n': x.t / (1 + exp(-greatest(least(ln(share) - ln(1 - share) - high + low + x.k * (ln(high) - ln(low)), 700), -700)))}}) AS e
            FROM em JOIN h USING (term) WHERE i < 50))),
mixtures AS (
    SELECT term, CASE WHEN high < low THEN 1 - share ELSE share END AS share, greatest(high, low) AS high, least(high, low) AS low FROM em WHERE i = 50),
scored AS (
    SELECT doc_id, term, v.c AS term_count, records, round(v.c * ln(n::DOUBLE / records), 6) AS score,
           round(1 / (1 + (1 - share) / share * exp(high - low + v.c * (ln(low) - ln(high)))), 6) AS elite
    FROM rows JOIN counts USING (term) LEFT JOIN mixtures USING (term), size)"""

_SIZED = r"""
sized AS (
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS size
    FROM documents)"""


_WORD = r"[\p{L}\p{N}]+"
# Invisible characters and spaces other than the plain one, as classes of characters.
_UNSEEN = r"[\p{Cf}\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}\x{2800}]"
_SPACES = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def _similar(k: int) -> str:
    """Pairs of documents with a shared run of ``k`` words: how many they share, and have."""
    return f"""
words AS (
    SELECT doc_id, regexp_extract_all(lower(CASE WHEN title IS NULL THEN text ELSE title || ' ' || text END), '[\\p{{L}}\\p{{N}}]+') AS w
    FROM documents WHERE regexp_matches(text, '{VISIBLE}')),
shingles AS (SELECT DISTINCT doc_id, w[i:i + {k - 1}] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_similar(3)} SELECT doc_a, doc_b FROM pairs WHERE k >= 0.5 * (na + nb - k)",
        "p3_groups": f"""
            WITH RECURSIVE {_similar(5)},
            near AS (SELECT doc_a, doc_b, k = na AND k = nb AS equal FROM pairs WHERE k >= 0.8 * (na + nb - k)),
            classes AS (SELECT doc_id, coalesce(min(doc_a), doc_id) AS class_id FROM sizes LEFT JOIN near ON doc_b = doc_id AND equal GROUP BY doc_id),
            edges AS (
                SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT doc_a, doc_b FROM near UNION ALL SELECT doc_b, doc_a FROM near)
                JOIN classes x ON x.doc_id = doc_a JOIN classes y ON y.doc_id = doc_b WHERE x.class_id <> y.class_id),
            reached AS (SELECT DISTINCT class_id AS origin, class_id AS node FROM classes UNION SELECT origin, b FROM reached JOIN edges ON a = node),
            named AS (SELECT origin, min(node) AS group_id FROM reached GROUP BY origin),
            degree AS (SELECT a, count(*) AS links FROM edges GROUP BY a)
            SELECT doc_id, class_id, group_id, coalesce(links, 0) AS links
            FROM classes JOIN named ON origin = class_id LEFT JOIN degree ON a = class_id""",
        "p4_found": f"""
            WITH {_INDEX},
            scored AS (
                SELECT doc_id, term, round(v.c * ln(n::DOUBLE / records), 6) AS score
                FROM rows JOIN counts USING (term), size)
            SELECT doc_id, term FROM scored WHERE score > 0
            QUALIFY score = max(score) OVER (PARTITION BY doc_id)""",
        "p4_scores": f"WITH RECURSIVE {_MIXTURES} SELECT * FROM scored",
        "p4_elite": f"WITH RECURSIVE {_MIXTURES} SELECT doc_id, term, elite FROM scored WHERE elite >= 0.5",
        "p5_found": f"WITH {_INDEX} SELECT term, {_MARK} AS mark FROM counts, size WHERE mark IS NOT NULL",
        "p5_terms": f"WITH {_INDEX} SELECT term, occurrences, records, {_MARK} AS mark FROM counts, size",
        "p5_words": f"""
            WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
            counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM words GROUP BY term),
            size AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
            SELECT term, occurrences, records, {_MARK} AS mark FROM counts, size""",
        "p6_found": f"WITH {_SIZED} SELECT doc_id FROM sized WHERE size > 1024",
        "p6_pieces": f"""
            WITH {_SIZED}, cut AS (SELECT doc_id, size, (size + 1023) // 1024 AS pieces FROM sized),
            each AS (SELECT *, unnest(range(greatest(pieces, 1))) AS piece FROM cut)
            SELECT doc_id, piece, pieces, piece * 1024 AS first_token, least(1024, size - piece * 1024) AS n_tokens FROM each""",
        "p6_fill": f"WITH {_SIZED} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS tokens, true AS none_too_full, true AS well_filled FROM sized",
        "p7_plain": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
            e AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM eval_items WHERE item_id IS NOT NULL),
            dw AS (SELECT doc_id, pos, w[pos:pos + 12] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d)),
            ew AS (SELECT item_id, pos, w[pos:pos + 12] AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS pos FROM e)),
            hits AS (SELECT DISTINCT doc_id, item_id, dw.pos AS pos, dw.pos - ew.pos AS shift FROM dw JOIN ew USING (run)),
            runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS part FROM hits),
            long AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM runs GROUP BY doc_id, item_id, shift, part)
            SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS words FROM long GROUP BY doc_id, item_id""",
        "p8_invisible": f"""
            SELECT doc_id, invisible, other_space FROM (
                SELECT doc_id, regexp_matches(text, '{_UNSEEN}') AS invisible, regexp_matches(text, '{_SPACES}') AS other_space FROM documents)
            WHERE invisible OR other_space""",
    }
