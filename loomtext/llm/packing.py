"""Filling fixed-capacity containers with texts: bounded-space online best fit.

Each partition packs its texts in one pass with a fixed number of open containers. A
bitset holds the free space of the open ones, so the best fit is its lowest bit at or
above the item's size. When no container fits and all are open, the fullest closes.
What partitions leave open is packed once more, group by group, as whole units.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import durable

# Fixed value: words, and single signs, as runs of letters, numbers and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Partitions whose open containers are packed together in the second pass.
MERGED_PARTITIONS = 64


def pattern_tokens(text: Column) -> Column:
    """Matches of ``TOKEN``, counted inside the JVM."""
    return F.regexp_count(text, F.lit(TOKEN))


def vocabulary_tokens(path: str) -> Callable[[Column], Column]:
    """A counter of the tokens of a public tokenizer's file (``tokenizers`` JSON).

    The file is read on the driver, and Spark hands it to the executors.
    """
    context = SparkSession.active().sparkContext
    context.addFile(path)
    name = os.path.basename(path)
    held: dict[str, object] = {}

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        if "t" not in held:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            held["t"] = Tokenizer.from_file(SparkFiles.get(name))
            held["t"].encode_special_tokens = True
        out = []
        batch = [t or "" for t in texts.to_pylist()]
        for lo in range(0, len(batch), 256):
            out += [len(e.ids) for e in held["t"].encode_batch_fast(batch[lo : lo + 256], add_special_tokens=False)]
        return pa.array(out, pa.int32())

    return count


class OpenBins:
    """At most ``limit`` open containers; ``put`` returns the container an item went to and those closed for it."""

    def __init__(self, capacity: int, limit: int, first: int = 0):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free: dict[int, list[int]] = {}
        self.bits = 0
        self.count = 0

    def _take(self, space: int) -> int:
        held = self.free[space]
        number = held.pop()
        if not held:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def put(self, size: int) -> tuple[int, list[int]]:
        closed: list[int] = []
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append(self._take(fullest))
            space, number = self.capacity, self.next
            self.next += 1
        left = space - size
        if left:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        else:
            closed.append(number)
        return number, closed


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, open_bins: int = 64, tokens: Callable[[Column], Column] = pattern_tokens) -> DataFrame:
    """Lay each text into containers of ``capacity`` tokens.

    One row for each piece: ``container``, ``key``, ``piece`` (from 0), ``pieces``,
    ``first_token`` and ``n_tokens``. Only a text of more than ``capacity`` tokens has several
    pieces, full ones and a rest. Rows are packed one by one, so repeated keys and rows each
    get their place. A null or empty text, or one without tokens, has one row with a null
    container and no tokens. Containers are numbered, with gaps. Longest texts only make
    more pieces. Sizes alone leave the JVM, never texts, unless the tokenizer needs them.
    """
    key_type = df.schema[key].dataType
    # not spread over more partitions: fewer of them leave fewer containers open
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sized = texts.select("key", F.coalesce(tokens(F.col("text")), F.lit(0)).cast("long").alias("size"))
    fields = ["part", "bin", "key", "piece", "pieces", "first_token", "n_tokens", "still_open"]
    schema = T.StructType([T.StructField(f, key_type if f == "key" else T.BooleanType() if f == "still_open" else T.LongType()) for f in fields])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bins = OpenBins(capacity, open_bins)
        waiting: dict[int, list[tuple]] = {}
        ready: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], fields)

        arrow = [pa.int64()] * 8
        arrow[7] = pa.bool_()
        for b in batches:
            arrow[2] = b.schema.field(0).type
            for k, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                whole, rest = divmod(size, capacity)
                pieces = whole + (rest > 0)
                if not pieces:
                    ready.append((part, None, k, 0, 0, 0, 0, False))
                for i in range(whole):
                    ready.append((part, bins.next, k, i, pieces, i * capacity, capacity, False))
                    bins.next += 1
                if rest:
                    number, closed = bins.put(rest)
                    waiting.setdefault(number, []).append((k, whole, pieces, whole * capacity, rest))
                    for c in closed:
                        ready += [(part, c, *row, False) for row in waiting.pop(c)]
                if len(ready) >= 8192:
                    yield batch(ready)
                    ready = []
        for c, rows in waiting.items():
            ready += [(part, c, *row, True) for row in rows]
        if ready:
            yield batch(ready)

    placed = sized.mapInArrow(first_pass, schema)
    return _merge_open(placed, key, capacity)


def _merge_open(placed: DataFrame, key: str, capacity: int) -> DataFrame:
    """Pack what partitions left open, best fit again; a group holds a bounded number of containers."""
    placed = durable(placed, "placed")
    rest = placed.where("still_open").groupBy("part", "bin").agg(F.sum("n_tokens").alias("size")).withColumn("team", F.expr(f"part div {MERGED_PARTITIONS}"))

    def second_pass(pdf):
        import pandas as pd

        bins = OpenBins(capacity, len(pdf))
        out = []
        pdf = pdf.sort_values(["size", "part", "bin"], ascending=[False, True, True])
        for part, number, size in zip(pdf["part"], pdf["bin"], pdf["size"]):
            out.append((part, number, bins.put(int(size))[0]))
        frame = pd.DataFrame(out, columns=["part", "bin", "to"])
        leader = frame.groupby("to")[["part", "bin"]].transform("first")
        return frame.assign(to_part=leader["part"], to_bin=leader["bin"])[["part", "bin", "to_part", "to_bin"]]

    moved = rest.groupBy("team").applyInPandas(second_pass, "part long, bin long, to_part long, to_bin long").where("part <> to_part or bin <> to_bin")
    joined = placed.where("still_open").join(moved, ["part", "bin"], "left").select(F.coalesce("to_part", "part").alias("part"), F.coalesce("to_bin", "bin").alias("bin"), "key", "piece", "pieces", "first_token", "n_tokens")
    rows = placed.where("not still_open").select(joined.columns).unionByName(joined)
    return rows.select(F.expr("shiftleft(part, 33) + bin").alias("container"), F.col("key").alias(key), "piece", "pieces", "first_token", "n_tokens")
