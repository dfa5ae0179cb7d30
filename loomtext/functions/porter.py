"""Porter's stemmer (1980) as SQL, so that it runs inside the engine's generated code.

The same steps are emitted for Spark and for DuckDB: each is a projection of the column
``w`` (the word so far), built from suffix tests and patterns both dialects share. A
consonantal y is written Y on the way. ``extended`` adds the well-known later departures
from the paper: short words stay, some irregular forms, ``logi``, ``bli``, ``fulli``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiouy]", "[aeiouy]"
_M_POSITIVE = f"^{_C}*{_V}+{_C}"
_M_ABOVE_1 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_M_IS_1 = f"^{_C}*{_V}+{_C}+{_V}*$"
_DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxY") + ")$"

# The suffix tables of the paper, in its order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# Irregular forms of the extended variant.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


@dataclass(frozen=True)
class Dialect:
    """Names that differ between the engines."""

    matches: str
    group: str
    every: str


SPARK, DUCKDB = Dialect("regexp_like", "$1", ""), Dialect("regexp_matches", "\\1", ", 'g'")


def steps(d: Dialect, extended: bool = True) -> list[str]:
    """Expressions over ``w``, to be applied one after the other; ``word`` is the untouched word."""

    def has(x: str, pattern: str) -> str:
        return f"{d.matches}({x}, '{pattern}')"

    def ends(suffix: str) -> str:
        return f"right(w, {len(suffix)}) = '{suffix}'"

    def stem(n: int) -> str:
        return f"left(w, greatest(length(w) - {n}, 0))"

    def cvc(x: str) -> str:
        three = has(x, f"{_C}{_V}[^aeiouywxY]$")
        return f"({three} OR {has(x, f'^{_V}{_C}$')})" if extended else three

    def ladder(rules, measure: str) -> str:
        whens = [f"WHEN {ends(s)} THEN CASE WHEN {has(stem(len(s)), measure)} THEN concat({stem(len(s))}, '{to}') ELSE w END" for s, to in rules]
        return "CASE " + " ".join(whens) + " ELSE w END"

    marked = f"regexp_replace(w, '^y', 'Y')", f"regexp_replace(w, '([aeiou])y', '{d.group}Y'{d.every})", f"regexp_replace(w, 'yy', 'yY'{d.every})"
    plural = f"WHEN length(w) = 4 AND {ends('ies')} THEN {stem(1)} " if extended else ""
    step_1a = f"CASE {plural}WHEN {ends('sses')} THEN {stem(2)} WHEN {ends('ies')} THEN {stem(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {stem(1)} ELSE w END"
    past = f"WHEN {ends('ied')} THEN CASE WHEN length(w) = 4 THEN {stem(1)} ELSE {stem(2)} END " if extended else ""
    step_1b = (
        f"CASE {past}WHEN {ends('eed')} THEN CASE WHEN {has(stem(3), _M_POSITIVE)} THEN {stem(1)} ELSE w END "
        f"WHEN {ends('ed')} AND {has(stem(2), _V)} THEN concat({stem(2)}, '|') WHEN {ends('ing')} AND {has(stem(3), _V)} THEN concat({stem(3)}, '|') ELSE w END"
    )
    # a trailing mark asks for the clean-up after step 1b
    bare = stem(1)
    clean = (
        f"CASE WHEN right(w, 1) <> '|' THEN w WHEN {has(bare, '(at|bl|iz)$')} THEN concat({bare}, 'e') "
        f"WHEN {has(bare, _DOUBLE)} THEN {stem(2)} WHEN {has(bare, _M_IS_1)} AND {cvc(bare)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    before_y = f"length(w) > 2 AND {has(stem(1), f'{_C}$')}" if extended else has(stem(1), _V)
    step_1c = f"CASE WHEN {has('w', '[yY]$')} AND {before_y} THEN concat({stem(1)}, 'i') ELSE w END"
    second = STEP_2
    if extended:
        second = tuple(("bli", "ble") if s == "abli" else (s, to) for s, to in STEP_2) + (("fulli", "ful"),)
    step_2 = ladder(second, _M_POSITIVE)
    if extended:
        log = f"WHEN {ends('logi')} THEN CASE WHEN {has(stem(3), _M_POSITIVE)} THEN {stem(1)} ELSE w END ELSE w END"
        step_2 = step_2.removesuffix("ELSE w END") + log
    first = [f"CASE WHEN {ends('alli')} AND {has(stem(4), _M_POSITIVE)} THEN {stem(2)} ELSE w END"] if extended else []
    whens = [f"WHEN {ends(s)} THEN CASE WHEN {has(stem(len(s)), _M_ABOVE_1)}{' AND ' + has(stem(3), '[st]$') if s == 'ion' else ''} THEN {stem(len(s))} ELSE w END" for s in STEP_4]
    step_4 = "CASE " + " ".join(whens) + " ELSE w END"
    step_5a = f"CASE WHEN {ends('e')} AND ({has(stem(1), _M_ABOVE_1)} OR {has(stem(1), _M_IS_1)} AND NOT {cvc(stem(1))}) THEN {stem(1)} ELSE w END"
    step_5b = f"CASE WHEN {ends('ll')} AND {has(stem(1), _M_ABOVE_1)} THEN {stem(1)} ELSE w END"
    last = "lower(w)"
    if extended:
        odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
        last = f"CASE WHEN length(word) <= 2 THEN word ELSE CASE word {odd} ELSE lower(w) END END"
    return [*marked, step_1a, step_1b, clean, step_1c, *first, step_2, ladder(STEP_3, _M_POSITIVE), step_4, step_5a, step_5b, last]


def stem_words(words: DataFrame, column: str = "term", extended: bool = True) -> DataFrame:
    """``words``, meant to be a vocabulary in lower case, with a column ``stem``."""
    out = words.withColumn("word", F.col(column)).withColumn("w", F.col(column))
    for expression in steps(SPARK, extended):
        out = out.withColumn("w", F.expr(expression))
    return out.withColumnRenamed("w", "stem").drop("word")


def stem_sql(source: str, column: str = "term", extended: bool = True) -> str:
    """A DuckDB query with the columns ``column`` and ``stem`` over the relation ``source``."""
    sql = f"SELECT {column} AS word, {column} AS w FROM {source}"
    for expression in steps(DUCKDB, extended):
        sql = f"SELECT word, {expression} AS w FROM ({sql})"
    return f"SELECT word AS {column}, w AS stem FROM ({sql})"
