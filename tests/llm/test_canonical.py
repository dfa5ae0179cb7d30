import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import canonical as c


@pytest.mark.parametrize(
    ("text", "form", "kinds"),
    [
        ("plain text, (signs) 1%\tand\nlines", None, 0),
        ("composed é, dash –, “quotes”, € ★ ½´"[:-2], None, 0),
        ("ｆｕｌｌ ﬁne 𝐛𝐨𝐥𝐝", "full fine bold", c.COMPATIBILITY),
        ("café", "café", c.SEPARATE_MARK),
        ("q́", None, 0),
        ("a​b﻿c­d", "abcd", c.INVISIBLE),
        ("a b　c d", "a b c d", c.SPACE),
        ("tһе раgе", "the page", c.LOOK_ALIKE),
        ("Привет мир", None, 0),
        ("λόγος Ω δ", None, 0),
        ("а", "a", c.LOOK_ALIKE),
        ("саѕе", "case", c.LOOK_ALIKE),
        ("ꓐig Ⲟne", "Big One", c.LOOK_ALIKE),
        ("ｅ́​", "é", c.COMPATIBILITY | c.SEPARATE_MARK | c.INVISIBLE),
        ("á̧", "á̧", c.SEPARATE_MARK),
        ("한", "한", 0),
        ("", "", 0),
        (None, None, 0),
        ("\x00bell\x07", "bell", c.INVISIBLE),
        ("´ ¨ stay", None, 0),
        ("\u1f71", "\u03ac", 0),
        ("\u03b1\u0301", "\u03ac", c.SEPARATE_MARK),
        ("\u0435\u0301t", "\u00e9t", c.SEPARATE_MARK | c.LOOK_ALIKE),
        ("日本語 עברית العربية", None, 0),
    ],
)
def test_cases(text, form, kinds):
    out, found = c.canonical_texts([text])
    assert out == [text if form is None else form]
    assert found == [kinds]


_T = c.form_tables()
_PLAIN = [chr(x) for x in range(0x20, c.LIMIT) if not 0xD800 <= x < 0xE000 and _T.flags[x] and _T.kind[x] != c.INVISIBLE and not _T.alike[x]]
_PLAIN = [x for x in _PLAIN if not (len(k := unicodedata.normalize("NFKD", x)) > 1 and k[0] == " ") and not any(_T.alike[ord(y)] for y in k) and x != "\u1680"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(_PLAIN), max_size=12), max_size=6))
def test_equals_normalization_without_look_alikes(texts):
    assert c.canonical_texts(texts)[0] == [unicodedata.normalize("NFKC", t) for t in texts]


def test_idempotent_and_independent_of_neighbours():
    r = random.Random(5)
    pool = [chr(x) for x in range(0x20, 0x250)] + list(c.LOOK_ALIKES) + [chr(x) for x in range(0x300, 0x330)] + ["​", "　", "ﬁ", "я", "λ"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 30))) for _ in range(500)]
    once, kinds = c.canonical_texts(texts)
    assert c.canonical_texts(once)[0] == once
    assert [c.canonical_texts([t])[0][0] for t in texts] == once
    assert all(k or a == b for a, b, k in zip(texts, once, kinds) if not any(unicodedata.combining(x) for x in a))


def test_long_text():
    assert c.canonical_texts(["х" * 2_000_000])[0] == ["x" * 2_000_000]


def test_frame(spark):
    rows = [(1, "ﬁ", "x"), (1, "ﬁ", "x"), (2, None, "x"), (None, "", "x"), (3, "ok", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = sorted(map(tuple, c.canonical_form(df).collect()), key=str)
    assert got == sorted([(1, "fi", 1), (1, "fi", 1), (2, None, 0), (None, "", 0), (3, "ok", 0)], key=str)
    assert c.canonical_form(df.limit(0)).count() == 0
    plan = c.canonical_form(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
