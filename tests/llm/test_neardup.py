import itertools
import random
import re

import numpy as np
import pytest

from loomtext.llm import neardup as nd

SCHEMA = "doc_id long, title string, text string, extra string"


def words(title, text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text if title is None else f"{title} {text}")]


def shingles(row, k):
    w = words(row[1], row[2])
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, least):
    sets = {r[0]: shingles(r, k) for r in rows if r[0] is not None and r[2] is not None and r[2].strip()}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = r.choices(vocabulary, k=r.randint(12, 120))
        for _ in range(r.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(r.randint(0, len(base) // 15)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            if r.random() < 0.3:
                cut = r.randrange(len(text))
                text = text[cut:] + text[:cut]
            rows.append((i, r.choice([None, "Title Words"]), " ".join(text), "e"))
            i += 1
    return rows


def pairs(spark, rows, **options):
    links, members = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    return {tuple(r) for r in nd.duplicate_pairs(links, members).collect()}, members


@pytest.mark.parametrize(("k", "least"), [(3, 0.5), (5, 0.8)])
def test_equals_brute_force(spark, k, least):
    rows = corpus()
    rows += [(900, None, rows[3][2].upper() + "!", "e"), (901, None, None, "e"), (902, "Title Words of some length here", "  ", "e"), (906, "Title Words of some length here", " \n\u00a0", "e"), (907, "Title Words of some length here", "\t", "e"), (903, None, "too short", "e"), (None, None, rows[3][2], "e"), (904, None, "a b c d e f", "e"), (905, None, "a b c d e f", "e")]
    got, members = pairs(spark, rows, shingle=k, similarity=least)
    assert got == brute(rows, k, least)
    ids = {r["doc_id"] for r in members.collect()}
    assert not ids & {901, 902, 903, 906, 907, None} and {904, 905} <= ids


def test_crowded_postings_lose_nothing(spark):
    """Boilerplate in every text, so postings are far above the limit and are refined."""
    r = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(0, 80, 2):
        own = [f"u{i}x{r.randrange(10**6)}" for _ in range(60)]
        rows.append((i, None, " ".join(common + own), "e"))
        own[5] = "changed"
        rows.append((i + 1, None, " ".join(common + own), "e"))
    got, _ = pairs(spark, rows, shingle=3, similarity=0.5, hot=8)
    assert got == brute(rows, 3, 0.5)
    got, _ = pairs(spark, rows, shingle=3, similarity=0.5, hot=4, levels=2)
    assert got == brute(rows, 3, 0.5)


def test_pair_with_one_common_block_in_a_crowded_posting(spark, monkeypatch):
    """Pairs that agree in two of three bytes of each block, and wholly in one that all records have."""
    block = "concat(lpad(hex(id div 2), 2, '0'), lpad(hex(id div 2), 2, '0'), lpad(hex(id), 2, '0'))"
    real = nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda *a: real(*a).selectExpr("id", "class_hi", "class_lo", "n", f"unhex(concat('000000', repeat({block}, 63))) as sig"))
    rows = [(i, None, " ".join([f"u{i // 2}x{j}" for j in range(20)] + [f"own{i}"]), "e") for i in range(40)]
    got, _ = pairs(spark, rows, shingle=3, similarity=0.5, hot=8)
    assert got == brute(rows, 3, 0.5) == {(i, i + 1) for i in range(0, 40, 2)}


def test_any_limit_on_postings_gives_the_same_pairs(spark):
    """Boilerplate in all records, pairs just above the limit: at any ``hot``, and in small batches."""
    r = random.Random(12)
    common = [f"c{i}" for i in range(50)]
    rows = []
    for i in range(0, 60, 2):
        own = [f"u{i}x{j}" for j in range(50)]
        rows.append((i, None, " ".join(common + own), "e"))
        other = list(own)
        for j in r.sample(range(50), 8):
            other[j] = f"o{i}x{j}"
        rows.append((i + 1, None, " ".join(common + other), "e"))
    expected = brute(rows, 3, 0.5)
    assert len(expected) == 30
    for hot in (2, 16, 256, 10**9):
        assert pairs(spark, rows, shingle=3, similarity=0.5, hot=hot)[0] == expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (3, 5, 100):
            assert pairs(spark, rows, shingle=3, similarity=0.5, hot=hot)[0] == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_postings_are_paired_or_crowded(spark):
    """Every posting by brute force: its pairs if it is small, else all its classes."""
    r = np.random.default_rng(2)
    sig = r.integers(0, 2, (90, 12), dtype=np.uint8)
    sig[:, :3] = 7
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "c long, sig binary").repartition(3)
    postings = {}
    for i, x in enumerate(sig):
        for p in range(4):
            postings.setdefault((p, x[3 * p : 3 * p + 3].tobytes()), []).append(i)
    for hot, size in ((4, "10"), (12, "10"), (12, "1000"), (200, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            entries = nd._entries(reps, 12, 3, hot)
            met = nd._met(entries, hot, 0).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs_of = {p for x in postings.values() if len(x) <= hot for p in itertools.combinations(x, 2)}
        assert {(min(m), max(m)) for m in met if m["b"] is not None} == pairs_of
        assert {m["a"] for m in met if m["b"] is None} == {c for x in postings.values() if len(x) > hot for c in x}
        if size == "1000" and hot == 12:
            assert entries.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3 * (hot + 1)


def test_bytes_after_the_block_are_counted(spark):
    """Pairs of one posting by the half bytes they share after it; round the end of the signature too."""
    r = np.random.default_rng(8)
    sig = r.integers(0, 3, (40, 24), dtype=np.uint8) * 25
    sig[:, 21:] = 9
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "c long, sig binary").repartition(3)
    for least in (0, 5, 8):
        met = nd._met(nd._entries(reps, 24, 3, 50), 50, least).collect()
        blocks = [(a, b, p) for a, b in itertools.combinations(range(40), 2) for p in range(8) if (sig[a, 3 * p : 3 * p + 3] == sig[b, 3 * p : 3 * p + 3]).all()]
        after = lambda p: (np.arange(16) + 3 * p + 3) % 24
        expected = {(a, b) for a, b, p in blocks if (sig[a, after(p)] // 16 == sig[b, after(p)] // 16).sum() >= least}
        assert {(min(m), max(m)) for m in met} == expected
    assert [nd.least_near(s) for s in (0.5, 0.8)] == [5, 10]


def test_chance_of_a_miss():
    """Pairs that agree in each byte with the chance of the similarity share a posting and enough half bytes after it."""
    r = np.random.default_rng(1)
    for similarity, most in ((0.5, 9e-4), (0.55, 2e-4), (0.8, 0)):
        same = r.random((20_000, 192)) < similarity
        block = same.reshape(20_000, 64, 3).all(axis=2)
        half = same | (r.random(same.shape) < 1 / 16)
        after = np.stack([np.roll(half, -3 * p - 3, axis=1)[:, :16].sum(axis=1) for p in range(64)], axis=1)
        assert 1 - (block & (after >= nd.least_near(similarity))).any(axis=1).mean() <= most


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_prefix_filter_loses_nothing(spark, least):
    r = random.Random(9)
    sets = [set(r.sample(range(40), r.randint(1, 30))) for _ in range(120)]
    sets += [s ^ set(r.sample(range(40), 3)) for s in sets]
    sets = [s or {1} for s in sets]
    df = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)], "id long, grams binary")
    got = {tuple(x) for x in nd._similar_sets(df, least).collect()}
    true = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    assert true and true <= got and all(a < b for a, b in got)


def test_boilerplate_below_the_limit_is_not_paired(spark, monkeypatch):
    """Half of the shingles in common is a similarity of a third: no result, and few candidates."""
    r = random.Random(6)
    rows = [(i, None, " ".join([f"c{j}" for j in range(60)] + [f"u{i}x{r.randrange(10**6)}" for _ in range(60)]), "e") for i in range(150)]
    rows += [(i, None, rows[i - 1000][2] + " more", "e") for i in range(1000, 1010)]
    seen = []

    def counted(name):
        inner = getattr(nd, name, None)
        if inner:
            def run(*a):
                out = inner(*a)
                seen.append((out[0] if isinstance(out, tuple) else out).count())
                return out

            monkeypatch.setattr(nd, name, run)

    counted("_candidates")
    counted("_similar_sets")
    got, _ = pairs(spark, rows, shingle=3, similarity=0.5, hot=8)
    assert got == brute(rows, 3, 0.5) == {(i, i + 1000) for i in range(10)}
    assert sum(seen) < 1500 < len(rows) * (len(rows) - 1) // 2 // 8


def test_exact_copies_form_one_class(spark):
    rows = [(i, None, "one two three four five six", "e") for i in range(50)] + [(99, None, "one two three four five six seven", "e")]
    links, members = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, similarity=0.5)
    assert links.count() == 1
    assert {r["class_id"] for r in members.where("doc_id < 50").collect()} == {0}
    assert nd.duplicate_pairs(links, members).count() == 51 * 50 // 2


def test_empty_and_repeated_rows(spark):
    assert pairs(spark, [])[0] == set()
    rows = [(1, None, "a b c d e f g", "e")] * 3 + [(2, None, "a b c d e f h", "e")]
    assert pairs(spark, rows, shingle=3, similarity=0.5)[0] == {(1, 2)}


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    assert pairs(spark, [(1, None, long, "e"), (2, None, long + " end", "e"), (3, None, "short one here", "e")])[0] == {(1, 2)}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    y = np.concatenate([x[:200], r.integers(0, 2**63, 100, dtype=np.uint64)])
    a, b = nd.permutations(192)
    sig = nd._signatures(np.concatenate([x, y]), np.array([300, 300]), a, b)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert nd.least_matches(192, 0.5) < 96 * 0.6


def test_groups_are_connected_components(spark):
    r = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = nd.components(spark.createDataFrame(edges, "class_a long, class_b long")).collect()
    assert {x["node"]: x["component"] for x in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert nd.components(spark.createDataFrame([], "class_a long, class_b long")).count() == 0


def test_groups_of_records(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [list(base)]
    for k in range(3):
        chain.append([*chain[-1][8:], *(f"n{k}{j}" for j in range(8))])
    rows = [(i, None, " ".join(t), "e") for i, t in enumerate(chain)] + [(10, None, " ".join(base), "e"), (11, None, "other words that stand alone here", "e")]
    links, members = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, similarity=0.7)
    got = {x["doc_id"]: (x["class_id"], x["group_id"], x["links"]) for x in nd.groups(links, members).collect()}
    assert got == {0: (0, 0, 1), 1: (1, 0, 2), 2: (2, 0, 2), 3: (3, 0, 1), 10: (0, 0, 1), 11: (11, 11, 0)}


def test_short_copies_share_a_class(spark, tmp_path):
    """Texts of fewer words than a shingle, by the registered query; those without words have no row."""
    from loomtext.llm.queries import queries

    rows = [(1, None, "Too short", "e"), (2, "too", "short!", "e"), (3, None, "too short a", "e"), (4, None, "short", "e"), (5, None, None, "e"), (6, None, " ", "e"), (7, None, "?!", "e"), (8, None, "too short a text of seven words", "e"), (9, None, "Short", "e")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["class_id"], x["group_id"], x["links"]) for x in queries()["p3_groups"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0), 3: (3, 3, 0), 4: (4, 4, 0), 8: (8, 8, 0), 9: (4, 4, 0)}
