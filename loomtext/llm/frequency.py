"""Frequencies of terms from compressed bitmaps of record numbers.

The layout is vertical: each task turns its rows into one bitmap of record numbers for
each term and container of 65,536 records, next to a counter of occurrences. Bitmaps of
one term and container are merged by union, and the document frequency is the number of
their bits. A frequent term is pre-aggregated inside each task, so it never gathers on
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import spread

RARE_BELOW, COMMON_ABOVE = 3, 0.2
#: Rows that a task combines before it passes their bitmaps on.
COMBINED_ROWS = 2_000_000

_ARRAY_MOST = 4096  # beyond so many numbers a bitmap of 8,192 bytes is smaller


def encode_container(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a list, or as a bitmap if that is smaller."""
    if low.size <= _ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def decode_container(data: bytes) -> np.ndarray:
    """The numbers of a container in order; lists have an even length, bitmaps an odd one."""
    if len(data) % 2 == 0:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little")).astype("<u2")


def union_containers(parts: list[bytes]) -> bytes:
    """The container of all numbers in any of ``parts``."""
    if len(parts) == 1:
        return parts[0]
    return encode_container(np.unique(np.concatenate([decode_container(p) for p in parts])))


def cardinality(data: bytes) -> int:
    if len(data) % 2 == 0:
        return len(data) // 2
    return int(np.bitwise_count(np.frombuffer(data, np.uint8, offset=1)).sum())


@F.arrow_udf(T.LongType())
def union_cardinality(parts: pa.Array) -> pa.Array:
    """Number of records in the union of each row's containers; single lists, nearly all, without a look at them."""
    number = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    size = pc.binary_length(parts.flatten()).to_numpy(zero_copy_only=False)
    first = np.cumsum(number) - number
    out = size[first] // 2 if size.size else np.zeros(0, np.int64)
    for i in np.flatnonzero((number > 1) | (size[first] % 2 > 0) if size.size else []).tolist():
        out[i] = cardinality(union_containers(parts[i].as_py()))
    return pa.array(out.astype(np.int64))


def _containers(term: pa.Array, record: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row for each term and container of some rows."""
    coded = term.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((record, code))
    code, record, times = code[order], record[order], times[order]
    new = np.ones(code.size, bool)
    new[1:] = (code[1:] != code[:-1]) | ((record[1:] >> 16) != (record[:-1] >> 16))
    first = np.flatnonzero(new)
    distinct = np.ones(code.size, bool)
    distinct[1:] = (code[1:] != code[:-1]) | (record[1:] != record[:-1])
    low = (record & 0xFFFF).astype("<u2")
    ends = np.append(first[1:], code.size)
    bitmaps = [encode_container(low[a:b][distinct[a:b]]) for a, b in zip(first.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(record[first] >> 16), pa.array(bitmaps, pa.binary()), pa.array(np.add.reduceat(times, first))], ["term", "container", "bitmap", "times"])


SCHEMA = "term string, container long, bitmap binary, times long"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of rows ``term``, ``record``, ``times``, combined over many rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= COMBINED_ROWS:
            yield from _combined(held)
            held, n = [], 0
    if n:
        yield from _combined(held)


def bitmap_frequencies(rows: DataFrame) -> DataFrame:
    """``term``, ``occurrences`` and ``records`` of rows ``term``, ``record`` (a long) and ``times``.

    The same term and record may come on several rows; their times add up.
    """
    return _merged(rows.select("term", "record", F.col("times").cast("long").alias("times")).mapInArrow(_bitmaps, SCHEMA))


def _combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held).combine_chunks()
    yield _containers(t.column("term").combine_chunks(), t.column("record").to_numpy(), t.column("times").to_numpy())


def _merged(bitmaps: DataFrame) -> DataFrame:
    # a term and container has at most one bitmap for each pass of a task over its rows
    merged = bitmaps.groupBy("term", "container").agg(F.collect_list("bitmap").alias("bitmaps"), F.sum("times").alias("times"))
    counted = merged.select("term", "times", union_cardinality("bitmaps").alias("records"))
    return counted.groupBy("term").agg(F.sum("times").alias("occurrences"), F.sum("records").alias("records"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id``, ``term``, ``times``, ordered by the first, with a number for each distinct one in its place.

    Numbers are dense within a task, and tasks have ranges of their own.
    """
    from pyspark import TaskContext

    number, last = (TaskContext.get().partitionId() << 33) - 1, None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        new = np.ones(b.num_rows, bool)
        new[0] = last is None or ids[0].as_py() != last
        new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        record = number + np.cumsum(new)
        number, last = int(record[-1]), ids[b.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(record), b.column(2)], ["term", "record", "times"])


def marked(counts: DataFrame, total: int, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``counts`` with a ``mark``: ``rare``, ``common`` or null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above * total), "common"))


def index_frequencies(index: DataFrame, catalog: DataFrame, reserved: str = "__all_docs__") -> DataFrame:
    """``term``, ``occurrences``, ``records`` and ``mark`` of each term of an inverted index.

    Terms are compared in lower case without blanks around; rows with a null term or
    record and the reserved key are left out. Of several rows of a term and record the
    latest counts (a repeated row counts once); a null count adds no occurrence but its
    record does count. ``common`` is measured against the distinct ids of ``catalog``.
    """
    total = catalog.select("doc_id").where("doc_id is not null").distinct().count()
    rows = clean_index(index, reserved).select("doc_id", "term", F.coalesce("term_count", F.lit(0)).cast("long").alias("times"))
    # a record's rows lie in one task, one for each of its terms, so numbers need no join
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    return marked(_merged(ordered.mapInArrow(lambda batches: _bitmaps(_numbered(batches)), SCHEMA)), total)


def _micros(df: DataFrame, time: str) -> Column:
    """A time as microseconds; one without a zone is taken as it is, whatever the session's zone."""
    if not isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.unix_micros(F.col(time).cast("timestamp"))
    return (F.expr(f"cast(cast(`{time}` - timestamp_ntz'1970-01-01' as interval second) as decimal(18, 6))") * 1_000_000).cast("long")


def clean_index(index: DataFrame, reserved: str) -> DataFrame:
    """The latest row of each term and record: ``term``, ``doc_id``, ``term_count``; ties go to the larger count.

    A row without a time is the oldest, and a null count less than any.
    """
    rows = index.select(F.lower(F.trim("term")).alias("term"), "doc_id", _micros(index, "written_at").alias("at"), F.col("term_count").cast("int").alias("n"))
    rows = rows.where((F.col("term") != reserved) & F.col("doc_id").isNotNull())
    # time and count as one number, as only such aggregates are hashed: 64 bits above 33
    below = F.lit(2**33).cast("decimal(11,0)")
    at = F.coalesce("at", F.lit(-(2**63))).cast("decimal(20,0)")
    version = (at * below + F.coalesce(F.col("n").cast("long") + 2**31 + 1, F.lit(0)).cast("decimal(11,0)")).cast("decimal(38,0)")
    latest = rows.groupBy("term", "doc_id").agg(F.max(version).alias("v"))
    low = F.pmod("v", below).cast("long")
    return latest.select("term", "doc_id", F.when(low > 0, low - 2**31 - 1).cast("int").alias("term_count"))


def text_frequencies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term``, ``occurrences``, ``records`` and ``mark`` of each word of the texts.

    Words are runs of letters and digits in lower case. ``key`` must be a whole number, of either sign; a
    key on several rows is one record, and null keys are left out. Null and empty texts have
    no words but count as records. Each task counts its words before anything is shuffled.
    """
    total = df.select(key).where(F.col(key).isNotNull()).distinct().count()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                words = pc.split_pattern_regex(pc.utf8_lower(part.column(1)), r"[^\p{L}\p{N}]+")
                parent = pc.list_parent_indices(words).to_numpy()
                flat = pc.list_flatten(words)
                some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                record = part.column(0).to_numpy()[parent[some]]
                held.append(pa.RecordBatch.from_arrays([flat.filter(pa.array(some)), pa.array(record), pa.array(np.ones(record.size, np.int64))], ["term", "record", "times"]))
                n += record.size
            if n >= COMBINED_ROWS:
                yield from _combined(held)
                held, n = [], 0
        if n:
            yield from _combined(held)

    rows = df.select(F.col(key).cast("long").alias("record"), F.col(text).cast("string").alias("text")).where("record is not null and text is not null")
    return marked(_merged(spread(rows).mapInArrow(build, SCHEMA)), total)
