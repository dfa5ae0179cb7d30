import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from loomtext.llm import distinct, frequency

SCHEMA = "term string, doc_id string, term_count int, postings array<int>, written_at timestamp, score string"
T0 = datetime(2024, 1, 1)


def index_rows():
    r = random.Random(6)
    rows = []
    for d in range(60):
        rows.append(("__all_docs__", f"d{d}", None, [], T0, "x"))
        for t in {"the", *(f"t{int(r.expovariate(0.05))}" for _ in range(8))}:
            rows.append((r.choice([t, f" {t}", t.upper()]), f"d{d}", r.randint(1, 5), [1], T0 + timedelta(minutes=len(rows)), "x"))
    rows += rows[10:40] + [(None, "d1", 1, [1], T0, "x"), ("nul", "d1", None, [1], T0, "x"), ("the", None, 1, [1], T0, "x"), ("the", "d0", 9, [1], T0 - timedelta(days=1), "x")]
    return rows


def latest(rows):
    best = {}
    for t, d, c, _, w, _ in rows:
        if t is None or d is None or t == "__all_docs__":
            continue
        key = (t.strip(" ").lower(), d)
        best[key] = max(best.get(key, (datetime.min, -1)), (w, -1 if c is None else c))
    return {k: v[1] for k, v in best.items()}


@pytest.fixture(scope="module")
def tables(spark):
    catalog = [(f"d{i}", 5) for i in range(60)] + [("d1", None), (None, 1), ("other", 0)]
    return spark.createDataFrame(index_rows(), SCHEMA), spark.createDataFrame(catalog, "doc_id string, doc_len int")


def test_index_frequencies(tables):
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequency.index_frequencies(*tables).collect()}
    counts, docs = Counter(), defaultdict(set)
    for (t, d), c in latest(index_rows()).items():
        counts[t] += max(c, 0)
        docs[t].add(d)
    mark = lambda n: "rare" if n < 3 else "common" if n > 0.2 * 61 else None
    assert got == {t: (counts[t], len(x), mark(len(x))) for t, x in docs.items()}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_latest_row(spark, kind):
    """The latest time counts, then the larger count; no time is the oldest, no count the least."""
    t = lambda s: datetime(1969, 12, 31, 23, 59, 59) + timedelta(microseconds=s)
    cases = {"a": ([(t(5), 1), (t(6), 0), (t(4), 9)], 0), "b": ([(t(5), 1), (t(5), 7), (t(5), None)], 7), "c": ([(None, 8), (t(-(10**15)), 2)], 2), "d": ([(None, 8), (None, 9)], 9), "e": ([(t(7), None), (t(6), 3)], None), "f": ([(None, None)], None), "g": ([(t(1), -4), (t(1), -5)], -4), "h": ([(datetime(2400, 1, 1), 2**31 - 1), (t(0), 1)], 2**31 - 1)}
    rows = [(k, "d", n, at) for k, (versions, _) in cases.items() for at, n in versions]
    df = spark.createDataFrame(rows, f"term string, doc_id string, term_count int, written_at {kind}")
    got = {r["term"]: r["term_count"] for r in frequency.clean_index(df, "__all_docs__").collect()}
    assert got == {k: n for k, (_, n) in cases.items()}
    assert "SortAggregate" not in frequency.clean_index(df, "x")._jdf.queryExecution().executedPlan().toString()


def test_scores_without_broadcast(tables, monkeypatch):
    """Frequent terms are joined in shards where the parameters are too many to broadcast."""
    expected = sorted(map(str, distinct.characteristic_terms(*tables).collect()))
    monkeypatch.setattr("loomtext.operators.skew.BROADCAST_ROWS", 3)
    got = distinct.characteristic_terms(*tables)
    assert sorted(map(str, got.collect())) == expected
    assert "passthrough" in got._jdf.queryExecution().executedPlan().toString()


def test_elite_terms(tables):
    scored = distinct.characteristic_terms(*tables)
    got = {(r["doc_id"], r["term"]) for r in distinct.elite_terms(scored).collect()}
    assert got == {(r["doc_id"], r["term"]) for r in scored.collect() if r["elite"] is not None and r["elite"] >= 0.5} != set()


def test_scores(tables):
    got = {(r["doc_id"], r["term"]): r for r in distinct.characteristic_terms(*tables).collect()}
    counts = latest(index_rows())
    df = Counter(t for t, _ in counts)
    assert set(got) == {(d, t) for t, d in counts}
    for (t, d), c in counts.items():
        row = got[d, t]
        if c < 0:
            assert row["score"] is None and row["elite"] is None
        else:
            assert row["score"] == pytest.approx(c * math.log(61 / df[t]), abs=1e-6)
            assert 0 <= row["elite"] <= 1
    best = defaultdict(set)
    for (t, d), c in counts.items():
        s = {u: got[d, u]["score"] or 0 for u, e in counts if e == d}
        if s[t] > 0 and s[t] == max(s.values()):
            best[d].add(t)
    assert {(r["doc_id"], r["term"]) for r in distinct.top_terms(distinct.characteristic_terms(*tables)).collect()} == {(d, t) for d, x in best.items() for t in x}


def test_empty_tables(tables):
    index, catalog = tables
    assert distinct.characteristic_terms(index.limit(0), catalog).count() == 0
    assert frequency.index_frequencies(index.limit(0), catalog).count() == 0
    assert {r["score"] for r in distinct.characteristic_terms(index, catalog.limit(0)).collect()} == {None}


def test_mixture_recovers_its_parameters():
    r = np.random.default_rng(1)
    elite = r.random(20000) < 0.1
    k = np.where(elite, r.poisson(6, elite.size), r.poisson(0.3, elite.size))
    count, times = np.unique(k, return_counts=True)
    share, high, low = distinct.fit_two_poisson(count.astype(float), times.astype(float), np.array([0]))
    assert share[0] == pytest.approx(0.1, abs=0.01) and high[0] == pytest.approx(6, abs=0.3) and low[0] == pytest.approx(0.3, abs=0.03)
    both = distinct.fit_two_poisson(np.tile(count, 2).astype(float), np.tile(times, 2).astype(float), np.array([0, count.size]))
    assert np.allclose(both[0], share[0]) and np.allclose(both[1], high[0])


def test_containers_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 4096, 4097, 65536):
        x = np.sort(r.permutation(65536)[:n]).astype("<u2")
        data = frequency.encode_container(x)
        assert np.array_equal(frequency.decode_container(data), x) and frequency.cardinality(data) == n
    a, b = np.arange(0, 9000, 2, dtype="<u2"), np.arange(0, 9000, 3, dtype="<u2")
    union = frequency.union_containers([frequency.encode_container(a), frequency.encode_container(b)])
    assert np.array_equal(frequency.decode_container(union), np.union1d(a, b))
    assert len(frequency.encode_container(np.arange(65536, dtype=np.uint32).astype("<u2"))) == 8193


def test_union_of_rows(spark):
    r = np.random.default_rng(4)
    sets = [[np.unique(r.integers(0, 65536, n)).astype("<u2") for n in sizes] for sizes in ([3], [5000], [10, 10], [5000, 60], [1], [], [40_000, 40_000])]
    rows = [(i, [bytearray(frequency.encode_container(x)) for x in s]) for i, s in enumerate(sets)]
    for kept in (rows, [x for x in rows if x[1]], []):
        df = spark.createDataFrame([x for x in kept if x[1]], "i int, parts array<binary>").repartition(2)
        got = {x["i"]: x["n"] for x in df.select("i", frequency.union_cardinality("parts").alias("n")).collect()}
        assert got == {i: len(set().union(*(x.tolist() for x in sets[i]))) for i, p in kept if p}


def test_bitmaps_over_tasks_and_containers(spark):
    r = random.Random(9)
    rows = [(r.choice("abc"), r.choice([-5, 3, 70_000, 70_001, 2**40]), 1) for _ in range(400)]
    got = {x["term"]: (x["occurrences"], x["records"]) for x in frequency.bitmap_frequencies(spark.createDataFrame(rows, "term string, record long, times int").repartition(7)).collect()}
    assert got == {t: (sum(1 for x in rows if x[0] == t), len({x[1] for x in rows if x[0] == t})) for t in "abc"}


def test_text_frequencies(spark):
    rows = [(1, "A a b, c1"), (1, "a"), (2, None), (3, ""), (None, "z"), (4, "É é"), (-9, "b " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["term"]: (x["occurrences"], x["records"], x["mark"]) for x in frequency.text_frequencies(df).collect()}
    assert got == {"a": (3, 1, "rare"), "b": (100_001, 2, "rare"), "c1": (1, 1, "rare"), "é": (2, 1, "rare")}
    assert frequency.text_frequencies(df.limit(0)).count() == 0
