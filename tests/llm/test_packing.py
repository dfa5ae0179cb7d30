import random

import pytest
from pyspark.sql import functions as F

from loomtext.llm import packing

from ..helpers import DATA


def check(rows, sizes, capacity):
    """Every text whole in one container, or split only beyond the capacity; no container too full."""
    used, by_key = {}, {}
    for r in rows:
        if r["container"] is not None:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        by_key.setdefault(r["doc_id"], []).append(r)
    assert all(0 < n <= capacity for n in used.values())
    for key, own in by_key.items():
        own.sort(key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in own) == sizes[key]
        assert len(own) == max(1, -(-sizes[key] // capacity))
        assert [r["first_token"] for r in own] == [i * capacity for i in range(len(own))]
        assert all(r["n_tokens"] == capacity for r in own[:-1])
    assert set(by_key) == set(sizes)
    return used


@pytest.mark.parametrize("partitions", [1, 5])
def test_random_texts(spark, partitions):
    r = random.Random(1)
    sizes = {i: r.choice([0, 1, 5, 30, 31, 32, 33, 64, 70, 200]) if r.random() < 0.3 else r.randint(1, 32) for i in range(800)}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), 0) for i, n in sizes.items()], "doc_id long, text string, container int").repartition(partitions)
    used = check(packing.pack(df, capacity=32, open_bins=16).collect(), sizes, 32)
    assert sum(used.values()) / (32 * len(used)) > 0.97


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "   \n"), (None, "a b"), (5, "x " * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=1024).collect()
    check(got, {1: 0, 2: 0, 3: 0, None: 2, 5: 5000}, 1024)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 4, "doc_id long, text string")
    assert packing.pack(same, capacity=6).count() == 4


def test_fullest_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.put(4) == (0, [])
    assert bins.put(7) == (1, [])
    assert bins.put(5) == (0, [])  # best fit: 6 free, not 3
    assert bins.put(8) == (2, [0])  # 1 free in bin 0, the fullest
    assert bins.put(3) == (1, [1])  # exactly full


def test_pattern_equals_python(spark):
    import re

    texts = ["don't _x_ 3.5½ ²x", "naïve — “q”…", "é é", "日本 語　  x\x1cy", "a​b", "\U0001d41e🙂🙂", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(packing.pattern_tokens(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]


def test_public_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world"), (2, None), (3, "x" * 5000)], "doc_id long, text string")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    sizes = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()}
    check(packing.pack(df, capacity=100, tokens=packing.vocabulary_tokens(path)).collect(), sizes, 100)


def test_fill_of_real_documents(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    packed = packing.pack(df).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    assert packed.agg(F.avg("n")).first()[0] > 0.97 * 1024
