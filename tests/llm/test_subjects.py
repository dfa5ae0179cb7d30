import random

import numpy as np
import pytest

from loomtext.llm import subjects
from loomtext.llm.codepoints import char_tables, explode

from ..helpers import DATA

WORDS = {"law": "judge court verdict witness appeal clause jury".split(), "sport": "match goal team referee league striker".split(), "music": "violin concert melody tenor rhythm cello".split()}
COMMON = "the a was said by near after week report people some many of in".split()


def sentence(r, area):
    words = r.choices(COMMON, k=6) + (r.choices(WORDS[area], k=3) if area else [])
    r.shuffle(words)
    return " ".join(words).capitalize() + "."


def document(r, areas):
    return " ".join(sentence(r, a) for a in areas)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    out = []
    for i in range(300):
        main, other = r.sample(sorted(WORDS), 2)
        areas = [main] * 8 if i % 2 else [main] * 5 + [other] * 4
        passing = next(a for a in WORDS if a not in areas)
        areas = [*areas, passing, None] if i % 3 == 0 else areas
        r.shuffle(areas)
        true = {a for a in WORDS if areas.count(a) >= 0.2 * len(areas)}
        out.append((i, document(r, areas), true))
    return out


def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in corpus] + [(900, None, "en"), (901, " ", None), (None, "judge court", "en")], "doc_id long, text string, lang string")
    labels = [(i, r.upper() + " " if i % 7 == 0 else r) for i, _, true in corpus[:200] for r in sorted(true)]
    labels += [(1, None), (2, "unknown"), (None, "law"), labels[0], (7777, "law")]
    areas = spark.createDataFrame([("law", ""), ("Sport", ""), ("music", ""), (None, "")], "subject string, about string")
    pages = [("p1", None, corpus[-50 % len(corpus)][1], 2, 1), ("p1", None, corpus[-1][1], 1, 1), ("p2", "t", None, 1, 1), ("p1", None, corpus[-50 % len(corpus)][1], 2, 1), ("p1", None, None, 3, 1), ("p1", None, " \n", 4, 1)]
    return docs, spark.createDataFrame(pages, "id string, title string, text string, revised_at int, loaded_at int"), spark.createDataFrame(labels, "doc_id long, subject string"), areas


def test_held_out_documents(spark, corpus):
    got = {}
    for r in subjects.subject_areas(*tables(spark, corpus)).collect():
        got.setdefault((r["origin"], r["rec_id"]), set()).add(r["subject"])
    held = corpus[200:]
    right = sum(got.get(("documents", str(i)), set()) == true for i, _, true in held)
    assert right >= 0.9 * len(held)
    assert got["wikipedia", "p1"] == corpus[250][2]
    assert not {("documents", "900"), ("documents", "901"), ("wikipedia", "p2")} & set(got)


def test_no_labels_and_no_areas(spark, corpus):
    docs, pages, labels, areas = tables(spark, corpus[:5])
    assert subjects.subject_areas(docs, pages, labels, areas.limit(0)).count() == 0
    assert subjects.subject_areas(docs, pages, labels.limit(0), areas).columns == ["origin", "rec_id", "subject", "share"]
    assert subjects.subject_areas(docs.limit(0), pages.limit(0), labels, areas).count() == 0


def test_every_text_with_content_has_an_area(spark):
    """No area reaches the least share: the largest share counts, or else the largest mean logit."""
    model = subjects.new_model(["law", "music", "sport"])
    for a in model.arrays():
        a[...] = 0
    cps, starts = explode(["judge", "violin"])
    slot = subjects._vocabulary(cps, subjects.words_of(cps, starts, char_tables()), char_tables())
    for word, area in zip(slot.slot[slot.each], (0, 1)):
        model.word[word, area] = 1
    model.out[0, 0] = model.out[1, 1] = 9
    model.bias[:] = -6, -5, -4
    rest = " Some more words." * 8
    rows = [(1, "Judge." + rest), (2, "Judge. Violin." + rest), (3, "Some words judge violin violin here today again."), (4, "Some words."), (5, "?!"), (6, None), (7, " \n"), (8, "\u200b"), (9, "Judge. Violin.")]
    got = subjects.area_shares(spark.createDataFrame(rows, "id long, text string"), model).collect()
    expected = [(1, "law", 1 / 9), (2, "music", 0.1), (3, "music", 0.0), (4, "sport", 0.0), (5, "sport", 0.0), (9, "law", 0.5), (9, "music", 0.5)]
    assert sorted((r["id"], r["subject"], round(r["share"], 9)) for r in got) == [(i, s, round(x, 9)) for i, s, x in expected]
    assert subjects.area_shares(spark.createDataFrame(rows[4:8], "id long, text string"), model).count() == 1


def test_gradient_is_right():
    r = np.random.default_rng(3)
    model = subjects.new_model(["a", "b"])
    texts = ["one two three", "four two", "", "five five six"]
    y = r.integers(0, 2, (4, 2)).astype(np.float32)
    f, y = subjects.document_examples(texts, y, char_tables())
    (word, gram), out, bias, _ = subjects.gradient(f, y, model)
    loss = lambda: subjects.gradient(f, y, model)[3]
    for array, grad, at in ((model.word, word[1][1], word[0][1]), (model.gram, gram[1][2], gram[0][2]), (model.out, out[3], 3)):
        for j in range(2):
            step, old = 0.01, array[at, j]
            array[at, j] = old + step
            up = loss()
            array[at, j] = old - step
            down = loss()
            array[at, j] = old
            assert (up - down) / (2 * step) == pytest.approx(grad[j], abs=2e-3)
    assert bias.shape == (2,)


def test_rounds_add_up_and_are_bounded(spark):
    """A round's total is the sum over all texts, and its size depends on the model only."""
    r = random.Random(5)
    model = subjects.new_model(["law", "music", "sport"])
    sizes = []
    for words in (20, 5000):
        texts = [(" ".join(f"w{r.randrange(3000)}" for _ in range(words)), r.sample(model.areas, 1)) for _ in range(40)]
        sample = spark.createDataFrame(texts, "text string, subjects array<string>").repartition(5)
        got = subjects._round(subjects._examples(sample, model.areas, None), model).gradients(model)
        y = np.array([[a in own for a in model.areas] for _, own in texts], np.float32)
        (word, gram), out, bias, _ = subjects.gradient(*subjects.document_examples([t for t, _ in texts], y, char_tables()), model)
        whole = [np.zeros_like(a) for a in model.arrays()]
        whole[0][word[0]], whole[1][gram[0]], whole[2], whole[3] = word[1], gram[1], out, bias
        for a, b in zip(got, whole):
            assert np.abs(a - b).max() <= 2e-3 * max(1, np.abs(b).max())
        total = subjects.Total(3)
        total.sums[:] = 1
        sizes.append(max(len(x) for x in total.slices().column(1).to_pylist()))
    assert sizes[0] == sizes[1] <= (subjects.WORD_SLOTS + subjects.GRAM_SLOTS + subjects.DIM + 1) / subjects.SLICES * 15 + 32


def test_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "id long, text string")
    labels = docs.select("id").selectExpr("id", "array('a') as subjects")
    assert subjects._sample(docs, labels, None, 100, 100, 10_000).count() == 20
    assert subjects._sample(docs, labels, None, 100, 7, 10_000).count() == 7


def test_sentences():
    text = 'One here. "Two?" he said! 3.5 is the 45. one since 1990. So is this…\nNext line without stop\n\nLast'
    cps, starts = explode([text, "Other text. End."])
    number = subjects.sentence_of(cps, starts)
    joined = text + "Other text. End."
    parts = ["".join(c for c, n in zip(joined, number) if n == k).strip() for k in sorted(set(number.tolist()))]
    assert [p for p in parts if p] == ["One here.", '"Two?"', "he said!", "3.5 is the 45. one since 1990.", "So is this…", "Next line without stop", "Last", "Other text.", "End."]


def test_agrees_with_hand_labels(spark):
    """On the given tables: most hand labels, some of which are wrong, are found."""
    read = lambda t: spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet")
    found = subjects.subject_areas(*(read(t) for t in ("documents", "wikipedia", "subject_labels", "subject_areas"))).where("origin = 'documents'")
    labels = read("subject_labels").selectExpr("cast(doc_id as string) as rec_id", "lower(trim(subject)) as subject").where("subject is not null").distinct()
    both = labels.join(found.select("rec_id", "subject"), ["rec_id", "subject"]).count()
    assert both > 0.85 * labels.count()
