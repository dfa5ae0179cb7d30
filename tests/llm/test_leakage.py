import random
import re

import numpy as np

from loomtext.llm import leakage
from loomtext.llm.canonical import canonical_texts
from loomtext.llm.codepoints import char_tables, explode, grams_of, words_of


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", canonical_texts([text or ""])[0][0])]


def brute(docs, items, span):
    grams = lambda t: {tuple(w[i : i + span]) for w in [words(t)] for i in range(len(w) - span + 1)}
    return {(d, i) for d, t in docs if d is not None for i, x in items if i is not None and grams(t) & grams(x)}


def test_equals_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 60)))) for i in range(30)]
    docs = []
    for i in range(80):
        text = r.choices(vocabulary, k=r.randint(0, 150))
        source = items[r.randrange(30)][1].split()
        cut = r.randint(8, 20)
        at = r.randrange(max(1, len(source) - cut + 1))
        where = r.randrange(len(text) + 1)
        docs.append((i, " ".join(text[:where] + source[at : at + cut] + text[where:])))
    items += [(90, None), (91, ""), (92, items[0][1]), (None, items[1][1])]
    docs += [(200, None), (201, ""), (None, items[1][1]), (202, "ｖ1, " + items[2][1].replace(" ", ",\n").upper().replace("V", "​v"))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, suite string"))
    found = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert set(found) == brute(docs, items, 13)
    for (d, i), row in found.items():
        a, b = words(dict(docs)[d]), words(dict(items)[i])
        x, y, n = row["doc_word"], row["item_word"], row["words"]
        assert a[x : x + n] == b[y : y + n] and n >= 13


def test_every_window_has_a_fingerprint():
    r = random.Random(8)
    for _ in range(50):
        shared = " ".join(f"s{r.randrange(5)}" for _ in range(13))
        a, b = (" ".join([*(f"{x}{r.randrange(9)}" for _ in range(r.randrange(20))), shared]) for x in "ab")
        prints = []
        for t in (a, b):
            grams, starts = grams_of(words_of(*explode([t]), char_tables()), 5)
            prints.append(set(grams[leakage._selected(grams, starts, 9)].tolist()))
        assert prints[0] & prints[1]


def test_repetitive_text_has_few_fingerprints():
    """One place for many windows, yet one in each; an item has all places of its least hashes."""
    r = random.Random(3)
    for words in (["a"] * 1000, ["a", "b"] * 500, ["a", "b", "c"] * 300, r.choices("ab", k=900), [f"w{r.randrange(10**6)}" for _ in range(900)]):
        grams, starts = grams_of(words_of(*explode([" ".join(words), "x", " ".join(words[:40])]), char_tables()), 5)
        for every in (False, True):
            at = set(leakage._selected(grams, starts, 9, every).tolist())
            for lo, hi in zip(starts[:-1], starts[1:]):
                for w in range(lo, hi - 8):
                    places = [p for p in range(w, w + 9) if grams[p] == grams[w : w + 9].min()]
                    assert at & set(places) and (not every or set(places) <= at)
            if not every:
                assert len(at) < 0.3 * grams.size


def test_repetitive_texts(spark):
    r = random.Random(21)
    phrase = [f"p{i}" for i in range(4)]
    texts = [["a"] * 300, ["a", "b"] * 100, phrase * 30, [*phrase * 3, "x", *phrase * 2], ["y", *phrase * 4, "z"], r.choices("ab", k=200), ["a"] * 12, [*["a"] * 13, "q"], [*phrase, "s", *phrase * 3]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items = [(i, " ".join(t[: 10 * i + 13])) for i, t in enumerate(reversed(texts))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, 13)
    for row in got:
        a, b = dict(docs)[row["doc_id"]].split(), dict(items)[row["item_id"]].split()
        assert a[row["doc_word"] :][: row["words"]] == b[row["item_word"] :][: row["words"]]


def test_longest_run():
    a, b = np.arange(20), np.concatenate([[99], np.arange(3, 18), [98]])
    assert leakage._longest(a, b, {2}) == (15, 3, 1)
    assert leakage._longest(a, b, {5}) == (0, 0, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")
    assert leakage.leaks(docs, items).collect()[0]["words"] == 30
    assert leakage.leaks(docs.limit(0), items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0
    twice = docs.unionByName(spark.createDataFrame([(1, "other text")], "doc_id long, text string"))
    assert leakage.leaks(twice.unionByName(docs), items).count() == 1


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leakage, "small", lambda df, text=None: df)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 30)))], "item_id long, text string")
    assert [tuple(r) for r in leakage.leaks(docs, items).collect()] == [(1, 7, 20, 10, 0)]


def test_frequent_passages_without_broadcast(spark, monkeypatch):
    """A passage in most documents and several items: the same rows, and no exchange on a fingerprint or item alone."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join([*r.choices("uvwxyz", k=r.randint(0, 40)), *(common if i % 4 else []), *r.choices("uvwxyz", k=20)])) for i in range(120)]
    items = [(i, " ".join(common[i:] + r.choices("uvwxyz", k=15))) for i in range(6)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(map(tuple, leakage.leaks(d, i).collect()))
    monkeypatch.setattr(leakage, "small", lambda df, text=None: df)
    got = leakage.leaks(d, i)
    assert sorted(map(tuple, got.collect())) == expected and {x[:2] for x in expected} == brute(docs, items, 13)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" not in plan and "shufflepartitionidpassthrough" in plan


def test_size_is_checked_before_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc")] * 5, "a int, t string")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(leakage.small(df, "t"))
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 10)
    assert hinted(leakage.small(df)) and not hinted(leakage.small(df, "t"))
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 4)
    assert not hinted(leakage.small(df))
