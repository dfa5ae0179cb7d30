"""Text analysis as Columns: lower-case, tokens, letters only, stop words, stems.

Everything up to stop words is built-in functions on an array, so it stays in generated
code. Stems are computed once for each distinct word and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable, spread
from ..operators.skew import uneven_join
from .porter import stem_words

# English stop words that consist of letters.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
wasn weren won wouldn
""".split()

# Signs that are tokens by themselves, and spaces other than the plain ones.
SIGNS = ",;:?!()[]{}\"@#$%&*<>«»“”‘’„`"
SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Contracted words, taken apart (groups 1, 3, 5, 7 and 2, 4, 6, 8).
CONTRACTED = (r"\b(can)(not)\b|\b(gon)(na)\b|\b(got)(ta)\b|\b(wan)(na)\b", r"\b(gim)(me)\b|\b(lem)(me)\b")
_PARTED = ("cannot", "gonna", "gotta", "wanna", "gimme", "lemme")
#: Dashes, dots, a full stop at the end of a sentence, and what follows an apostrophe; none of them has letters only.
ENDINGS = r"--+|[.][.][.]+|([.]'*|n't|'(s|m|d|ll|re|ve)?)(\s|$)"
LETTERS = r"^\p{L}+$"


@dataclass(frozen=True)
class Analyzer:
    """Which steps follow the tokens; without both, only letters in lower case are kept."""

    stop_words: bool = True
    stem: bool = True


RAW, CLEAN = Analyzer(False, False), Analyzer()


def word_tokens(text: Column, stop_words: bool = False) -> Column:
    """Tokens of letters in lower case, in order; a token with any other sign is dropped whole.

    Signs that would be tokens are blanked, as they'd be dropped. A null text has a null
    array, an empty one an empty array.
    """
    out = F.lower(text)
    apart = out
    for pattern, to in zip(CONTRACTED, ("$1$3$5$7 $2$4$6$8", "$1$3 $2$4")):
        apart = F.regexp_replace(apart, pattern, to)
    rare = [F.contains(out, F.lit(w)) for w in _PARTED]
    out = F.when(reduce(lambda a, b: a | b, rare), apart).otherwise(out)
    out = F.regexp_replace(F.translate(out, SIGNS + SPACES, " " * len(SIGNS + SPACES)), ENDINGS, " ")
    tokens = F.filter(F.split(out, r"\s+"), lambda t: t.rlike(LETTERS))
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS)) if stop_words else tokens


def tokens_sql(source: str, key: str, text: str, stop_words: bool = False) -> str:
    """DuckDB twin of :func:`positions` without stems: ``doc_id``, ``pos``, ``term``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"lower({text})"
    for pattern, to in zip(CONTRACTED, (r"\1\3\5\7 \2\4\6\8", r"\1\3 \2\4")):
        out = f"regexp_replace({out}, {quoted(pattern)}, '{to}', 'g')"
    out = f"regexp_replace(translate({out}, {quoted(SIGNS + SPACES)}, '{' ' * len(SIGNS + SPACES)}'), {quoted(ENDINGS)}, ' ', 'g')"
    stop = " AND NOT list_contains([{}], t)".format(", ".join(f"'{w}'" for w in STOP_WORDS)) if stop_words else ""
    kept = f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda t: regexp_matches(t, '{LETTERS}'){stop})"
    return f"SELECT doc_id, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS pos, unnest(k) AS term FROM (SELECT CAST({key} AS VARCHAR) AS doc_id, {kept} AS k FROM {source})"


def positions(docs: DataFrame, analyzer: Analyzer = CLEAN) -> DataFrame:
    """``doc_id``, ``pos`` and ``term`` of documents ``doc_id``, ``content``.

    Positions count what is left after filtering, so neighbours may have had stop words or
    signs between them.
    """
    tokens = spread(docs).select("doc_id", F.posexplode(word_tokens(F.col("content"), analyzer.stop_words)).alias("pos", "term"))
    if not analyzer.stem:
        return tokens
    # the stems of all words are broadcast if they are few; a frequent word is never gathered in a task
    stems = durable(stem_words(tokens.select("term").distinct()), "stems")
    return uneven_join(tokens, stems, "term", ["doc_id"]).select("doc_id", "pos", F.col("stem").alias("term"))


def analyze_words(spark, words: list[str], analyzer: Analyzer) -> dict[str, list[str]]:
    """Terms of each query word under the analyzer; a stop word or a sign has none."""
    plain = not analyzer.stem and all(w.isascii() and w.isalpha() and w.lower() not in _PARTED for w in words)
    if plain or not words:
        return {w: [] if analyzer.stop_words and w.lower() in STOP_WORDS else [w.lower()] for w in words}
    rows = spark.createDataFrame([(w, w) for w in dict.fromkeys(words)], "doc_id string, content string")
    out: dict[str, list[str]] = {w: [] for w in words}
    for r in positions(rows, analyzer).orderBy("doc_id", "pos").collect():
        out[r["doc_id"]].append(r["term"])
    return out
