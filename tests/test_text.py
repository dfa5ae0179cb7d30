import pytest
from pyspark.sql import functions as F

from loomtext.functions.analyze import CLEAN, RAW, Analyzer, positions, word_tokens
from loomtext.functions.porter import stem_words


def tokens(spark, text, stop=False):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(word_tokens(F.col("t"), stop)).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Python is popular.", ["python", "is", "popular"]),
        ("well-known 3d U.S. covid19 fine", ["fine"]),
        ("don't cannot it's", ["do", "can", "not", "it"]),
        ("“Quoted,” she said: 'no'", ["quoted", "she", "said"]),
        ("À la carte – œuvre", ["à", "la", "carte", "œuvre"]),
        ("end.\nNext  one two", ["end", "next", "one", "two"]),
        ("", []),
        ("!?", []),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, text) == expected


def test_null_text(spark):
    assert tokens(spark, None) is None


def test_analyzer_sentence(spark):
    # Fixed value: the sentence of the fixtures.
    docs = spark.createDataFrame([("d", "The quick brown foxes jumped over the lazy dogs. Natural Language Processing is amazing!")], "doc_id string, content string")
    got = [r["term"] for r in positions(docs, CLEAN).orderBy("pos").collect()]
    assert got == "quick brown fox jump lazi dog natur languag process amaz".split()
    assert positions(docs, RAW).count() == 14
    assert positions(docs, Analyzer(True, False)).count() == 10


# Examples of the paper.
PAPER = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}
LATER = {"uses": "use", "dies": "die", "tied": "tie", "say": "say", "enjoy": "enjoy", "news": "news", "dying": "die", "as": "as", "geologi": "geolog", "possibli": "possibl", "succeed": "succeed"}


def stems(spark, words, extended):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    return {r["term"]: r["stem"] for r in stem_words(df, extended=extended).collect()}


def test_porter_paper(spark):
    got = stems(spark, PAPER, False)
    assert {w: got[w] for w in PAPER if got[w] != PAPER[w]} == {}
    assert stems(spark, ["say", "uses"], False) == {"say": "sai", "uses": "us"}


def test_porter_extended(spark):
    same = {w: s for w, s in PAPER.items()}
    got = stems(spark, {**same, **LATER}, True)
    assert {w: got[w] for w in LATER if got[w] != LATER[w]} == {}
    assert {w: got[w] for w in same if got[w] != same[w]} == {}
