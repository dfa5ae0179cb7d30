"""Near-duplicate records: byte-position inverted index, count filter, exact check.

A record becomes the set of its word shingles. Its signature has one byte for each of
``positions`` min-wise hash functions, so two records of similarity s agree at a position
with probability s (and 1/256 of the rest). The inverted index maps blocks of
``block`` neighbouring bytes with their position to records; an entry also carries, in one
number, the upper halves of the ``NEAR`` bytes that follow the block. Inside a posting the
shared ones of these are tallied for each pair, and pairs with enough are candidates. For each candidate pair the shared
positional bytes are tallied over the whole signatures, pairs below the guaranteed minimum
are dropped, and the rest are verified on their shingle sets.

Records of one shingle set form a class that is indexed once. A posting with more than
``hot`` classes is never expanded: the pairs among the classes of all such postings are
found by an exact prefix filter on their shingle sets, in which what most of them share
hardly takes part. No task sends more than a few entries of such a posting on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import discard, durable, scope, spread
from .codepoints import VISIBLE, char_tables, chunked, explode, grams_of, words_of


#: Bytes after its block of which an index entry carries the upper halves.
NEAR = 16


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash functions, the same in every run."""
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def least_matches(positions: int, similarity: float) -> int:
    """Positional bytes that a pair of the given similarity shares but for a chance of about 1e-9."""
    return max(1, math.floor(positions * similarity - 6 * math.sqrt(positions * similarity * (1 - similarity))))


def least_near(similarity: float) -> int:
    """Half bytes after a common block that a pair of the given similarity shares but for a chance of about 1 in 50."""
    p, k = similarity + (1 - similarity) / 16, 0
    below = (1 - p) ** NEAR
    while below <= 0.022:
        k += 1
        below += math.comb(NEAR, k) * p**k * (1 - p) ** (NEAR - k)
    return k


def _distinct(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and the text of each."""
    doc = np.repeat(np.arange(starts.size - 1), np.diff(starts))
    grams = grams.copy()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):  # each text's own, in place
        grams[a:b].sort()
    new = np.ones(grams.size, bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.bincount(doc[new], minlength=starts.size - 1), doc[new]


def _signatures(grams: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One byte for each hash function and text that has shingles."""
    some = np.flatnonzero(counts)
    begins = (np.cumsum(counts) - counts)[some]
    out = np.empty((some.size, a.size), np.uint8)
    half = (grams >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, some.size, 256):  # small enough to stay in the processor's cache
        part = begins[lo : lo + 256]
        end = begins[lo + 256] if lo + 256 < some.size else half.size
        h, at = half[part[0] : end], part - part[0]
        for j in range(a.size):
            least = np.minimum.reduceat(h * a[j] + b[j], at)
            out[lo : lo + 256, j] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
    return out


def _text_of(title: str | None, text: str) -> str:
    return text if title is None else f"{title} {text}"


def signatures(df: DataFrame, shingle: int, positions: int, short: bool = False) -> DataFrame:
    """``id``, ``class_hi`` and ``class_lo`` (128 bits of the shingle set), ``n`` shingles, ``sig``."""
    tables = df.sparkSession.sparkContext.broadcast(char_tables())
    a, b = permutations(positions)
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("class_hi", "class_lo", "n")), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text_of(ti, te) for ti, te in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for lo, hi in chunked(texts):
                grams, starts = grams_of(words_of(*explode(texts[lo:hi]), tables.value), shingle, short)
                grams, counts, doc = _distinct(grams, starts)
                some = np.flatnonzero(counts)
                begins = (np.cumsum(counts) - counts)[some]
                high = np.add.reduceat(grams * np.uint64(0x9E3779B97F4A7C15), begins) if some.size else grams
                low = np.add.reduceat((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), begins) if some.size else grams
                sig = _signatures(grams, counts, a, b) if some.size else np.zeros((0, positions), np.uint8)
                flat = pa.py_buffer(sig.tobytes())
                offsets = pa.py_buffer((np.arange(some.size + 1, dtype=np.int32) * positions).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + lo)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(counts[some].astype(np.int64)), pa.Array.from_buffers(pa.binary(), some.size, [None, offsets, flat])], [f.name for f in schema])

    return spread(df.select("id", "title", "text")).mapInArrow(run, schema)


def shingle_sets(df: DataFrame, shingle: int, short: bool = False) -> DataFrame:
    """``id`` and ``grams``, the shingle set as sorted 64-bit hashes in one binary."""
    tables = df.sparkSession.sparkContext.broadcast(char_tables())
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text_of(ti, te) for ti, te in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for lo, hi in chunked(texts):
                grams, counts, _ = _distinct(*grams_of(words_of(*explode(texts[lo:hi]), tables.value), shingle, short))
                ends = np.cumsum(counts).tolist()
                sets = [grams[e - c : e].tobytes() for e, c in zip(ends, counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "grams"])

    return df.select("id", "title", "text").mapInArrow(run, schema)


def _bytes_of(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values behind each other, and where each begins and the last ends."""
    ends = np.frombuffer(v.buffers()[1], np.int32, len(v) + 1, 4 * v.offset)
    data = v.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


@F.arrow_udf(T.IntegerType())
def shared_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Positions at which two signatures agree."""
    if not len(a):
        return pa.array([], pa.int32())
    x, y = (_bytes_of(v)[0].reshape(len(a), -1) for v in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


@F.arrow_udf(T.DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Intersection over union of two sets, each without repeats."""
    if not len(a):
        return pa.array([], pa.float64())
    (x, ex), (y, ey) = _bytes_of(a), _bytes_of(b)
    nx, ny = np.diff(ex) // 8, np.diff(ey) // 8
    values = np.concatenate([np.frombuffer(v.tobytes(), np.uint64) for v in (x, y)])
    row = np.concatenate([np.repeat(np.arange(len(a)), n) for n in (nx, ny)])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    both = np.bincount(row[1:][(values[1:] == values[:-1]) & (row[1:] == row[:-1])], minlength=len(a))
    return pa.array(both / np.maximum(nx + ny - both, 1))


def _similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a`` < ``b`` of ``id`` whose shingle sets may have the similarity, none that has it left out.

    Exact prefix filter. Shingles are ordered by frequency, the rarest first, in all sets
    alike. A pair of sizes x and y needs s / (1 + s) * (x + y) common shingles, so the first
    common one has at least as many left from it on in both sets; other meetings are dropped
    in the join. The shorter set thus needs only its rarest 1 - 2s / (1 + s), the longer one
    its rarest 1 - s, and what most records share is mostly in neither.
    """
    schema = T.StructType([sets.schema["id"], T.StructField("g", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                g = np.frombuffer(data, np.int64)
                for lo in range(0, g.size, 100_000):
                    part = g[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(part.size, i))), pa.array(part), pa.array(np.full(part.size, g.size))], ["id", "g", "n"])

    each = durable(sets.mapInArrow(run, schema), "shingles")
    # a shingle of one record meets nothing; it only counts as one of those that come first
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    ranked = each.join(often, "g").select("id", "g", "n", (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "g")) - 1).alias("at"))
    need = similarity / (1 + similarity)
    early = durable(ranked.where(f"n - at >= {similarity} * n - 1e-6").select("id", "g", "n", (F.col("n") - F.col("at")).alias("left")), "prefixes")
    short = early.where(f"left >= {2 * need} * n - 1e-6").select("g", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    long = early.select("g", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    met = short.join(long, "g").where(f"(nx < ny or nx = ny and x < y) and least(lx, ly) >= {need} * (nx + ny) - 1e-6")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, its size, and the place of each entry in its run."""
    new = np.ones(sorted_keys.size, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, sorted_keys.size))
    return first, size, np.arange(sorted_keys.size) - np.repeat(first, size)


def _entries(reps: DataFrame, positions: int, block: int, hot: int) -> DataFrame:
    """Index entries ``key``, a position and its bytes as a number; ``c``, the class; and ``near``, half of each byte after.

    Of a posting that exceeds ``hot`` in one Arrow batch alone only one more than that are
    sent on; the classes of the others come with a negative key, a different one each.
    """
    if positions % block or 8 * block + (positions // block).bit_length() > 62:
        raise ValueError("a key is a position and a block of at most a few bytes, and blocks fill the signature")
    near = (np.arange(0, positions, block)[:, None] + block + np.arange(NEAR)) % positions
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("c", reps.schema["c"].dataType), T.StructField("near", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            whole = _bytes_of(b.column(1))[0].reshape(b.num_rows, positions)
            sig = whole.reshape(b.num_rows, -1, block)
            key = np.broadcast_to(np.arange(sig.shape[1], dtype=np.int64), sig.shape[:2])
            for j in range(block):
                key = key * 256 + sig[:, :, j]
            key = key.ravel()
            order = np.argsort(key, kind="stable")
            half = whole >> 4
            after = (half[:, near[:, 0::2]] << 4 | half[:, near[:, 1::2]]).reshape(-1, NEAR // 2).view(np.int64).ravel()[order]
            key, row = key[order], order // sig.shape[1]
            beyond = _runs(key)[2] > hot
            left = np.unique(row[beyond])
            keys = np.concatenate([key[~beyond], -1 - np.arange(left.size)])
            after = np.concatenate([after[~beyond], np.zeros(left.size, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(np.concatenate([row[~beyond], left]))), pa.array(after)], [f.name for f in schema])

    return reps.select("c", "sig").mapInArrow(run, schema)


def _met(entries: DataFrame, hot: int, least: int) -> DataFrame:
    """Pairs ``a``, ``b`` of classes in a posting of at most ``hot`` that share ``least`` of the half
    bytes after the block; a class of a larger posting with a null ``b``.

    A task reads its postings in order and holds one at a time, the large ones not even whole.
    """
    c = entries.schema["c"].dataType
    schema = T.StructType([T.StructField("a", c), T.StructField("b", c)])

    def crowd(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(1), pa.nulls(part.num_rows, part.column(1).type)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # entries of the last posting so far; its key if it is a large one
        for b in batches:
            if large is not None and b.num_rows and (same := int(np.searchsorted(b.column(0).to_numpy(), large, "right"))):
                yield crowd(b.slice(0, same))
                b = b.slice(same)
            if not b.num_rows:
                continue
            if held is not None and held.num_rows:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            first, size, _ = _runs(b.column(0).to_numpy())
            yield from _pairs(b.slice(0, int(first[-1])), hot, least, crowd)
            held, large = b.slice(int(first[-1])), None
            if held.num_rows > hot or held.column(0)[0].as_py() < 0:
                yield crowd(held)
                held, large = held.slice(0, 0), held.column(0)[0].as_py()
        if held is not None:
            yield from _pairs(held, hot, least, crowd)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _pairs(part: pa.RecordBatch, hot: int, least: int, crowd) -> Iterator[pa.RecordBatch]:
    """Each entry of some whole postings with those of all that follow it there that share enough bytes."""
    if not part.num_rows:
        return
    key = part.column(0).to_numpy()
    _, size, place = _runs(key)
    whole = np.repeat(size, size)
    out = (whole > hot) | (key < 0)
    if out.any():
        yield crowd(part.take(pa.array(np.flatnonzero(out))))
    after = np.where(out, 0, whole - 1 - place)
    near = part.column(2).to_numpy()
    cuts = np.searchsorted(np.cumsum(after), np.arange(0, after.sum(), 1_000_000))
    for lo, hi in zip(cuts, [*cuts[1:], after.size]):
        n = after[lo:hi]
        if not n.any():
            continue
        left = np.repeat(np.arange(lo, hi), n)
        right = left + 1 + np.arange(left.size) - np.repeat(np.cumsum(n) - n, n)
        differ = (near[left] ^ near[right]).view(np.uint8).reshape(-1, NEAR // 2)
        shared = ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)
        left, right = left[shared >= least], right[shared >= least]
        yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(left)), part.column(1).take(pa.array(right))], ["a", "b"])


def _candidates(reps: DataFrame, positions: int, block: int, hot: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs ``a`` < ``b`` of classes that share a posting of at most ``hot`` and ``least`` half bytes after it,
    and the classes ``c`` of larger postings, whose pairs may be missing; None if there is no such posting."""
    met = durable(_met(_entries(reps, positions, block, hot), hot, least), "met")
    found = met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowded = met.where("b is null").select(F.col("a").alias("c"))
    return found, None if crowded.isEmpty() else crowded.distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """Distinct ``id`` of both ends, with a broadcast hint if they are counted to be at most a million."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return F.broadcast(ids) if ids.limit(1_000_001).count() <= 1_000_000 else ids


def _tallied(pairs: DataFrame, reps: DataFrame, similarity: float, positions: int) -> DataFrame:
    """Pairs whose signatures share the guaranteed minimum of bytes, and that may be similar by size.

    Signatures of classes in no pair stay where they are.
    """
    used = reps.withColumnRenamed("c", "id").join(_ends(pairs), "id", "left_semi")
    side = lambda x: used.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    return joined.where(shared_bytes("sig_a", "sig_b") >= least_matches(positions, similarity)).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = "title", shingle: int = 5, similarity: float = 0.8, positions: int = 192, block: int = 3, hot: int = 256, levels: int = 3, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links between classes of records, and the class of each record.

    Returns ``links(class_a, class_b, similarity)``, every pair of classes whose shingle
    sets have at least the given similarity, and ``members(key, class_id)``; a class is named
    by its least key, and its records have equal shingle sets. A null or blank text and a
    text of fewer than ``shingle`` words have no shingles and are in no class; with ``short`` a text
    of fewer words, but one at least, has all its words as its only shingle. A null title is
    left out. Rows repeated with one key count once.

    A pair of similarity s has no common posting with a chance of
    (1 - s^block)^(positions / block), and the half bytes after the block leave out one in fifty of
    the postings: 3e-4 in all at 0.5, 2e-5 at 0.55, below 1e-16 at 0.8. The size of a posting adds nothing to it.
    ``levels`` has no effect any more; it is kept for callers.
    """
    rows = df.select(F.col(key).alias("id"), (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("title"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").rlike(VISIBLE))
    signed = durable(signatures(rows, shingle, positions, short), "signatures")
    # copies are counted down to their least record inside each task, however many there are
    names = durable(signed.groupBy("class_hi", "class_lo").agg(F.min("id").alias("c")), "names")
    members = signed.select("id", "class_hi", "class_lo").join(names, ["class_hi", "class_lo"]).select(F.col("id").alias(key), F.col("c").alias("class_id")).distinct()
    # should one id with several texts lead several classes, the least class stands for it
    leads = names.groupBy("c").agg(F.min(F.struct("class_hi", "class_lo")).alias("class"))
    led = signed.join(leads, signed["id"] == leads["c"]).where("class_hi = class.class_hi and class_lo = class.class_lo")
    with scope() as spare:
        reps = durable(led.select("c", "n", "sig").dropDuplicates(["c"]), "classes")
        pairs, crowded = _candidates(reps, positions, block, hot, least_near(similarity))
        if crowded is not None:
            held = shingle_sets(rows.join(crowded.withColumnRenamed("c", "id"), "id", "left_semi"), shingle, short).dropDuplicates(["id"])
            pairs = pairs.unionByName(_similar_sets(held, similarity)).distinct()
        kept = spare(durable(_tallied(durable(pairs, "candidates"), reps, similarity, positions), "pairs"))
    sets = shingle_sets(rows.join(_ends(kept), "id", "left_semi"), shingle, short).dropDuplicates(["id"])
    sets = durable(sets, "sets")
    exact = kept.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = exact.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), jaccard("grams_a", "grams_b").alias("similarity")).where(F.col("similarity") >= similarity)
    return links, members


def duplicate_pairs(links: DataFrame, members: DataFrame, key: str = "doc_id") -> DataFrame:
    """All pairs ``doc_a`` < ``doc_b`` of linked records, those inside a class included."""
    side = lambda c, k: members.select(F.col("class_id").alias(c), F.col(key).alias(k))
    across = links.join(side("class_a", "x"), "class_a").join(side("class_b", "y"), "class_b").select("x", "y")
    shared = members.groupBy("class_id").count().where("count > 1").select("class_id")
    several = members.join(shared, "class_id")
    inside = several.select("class_id", F.col(key).alias("x")).join(several.select("class_id", F.col(key).alias("y")), "class_id").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def components(links: DataFrame, a: str = "class_a", b: str = "class_b") -> DataFrame:
    """``node`` and ``component``, its least node, of all nodes that have a link.

    Each round every node points its larger neighbours, then its smaller ones, to the least
    neighbour it knows. Rounds use joins and minima only, so a hub never gathers its
    neighbours in one task; each round is a durable table.
    """
    edges = durable(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, durable(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(last)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups(links: DataFrame, members: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each record: ``key``, its ``class_id``, its ``group_id`` and ``links``.

    Records are of one group if a chain of links connects them; a group is named by its least
    class. ``links`` counts the other classes that the record's class is similar to.
    """
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    named = components(links).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    out = members.join(named, "class_id", "left").join(degree, "class_id", "left")
    return out.select(key, "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
