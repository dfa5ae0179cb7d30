"""Per-key work without a few tasks that run far longer than all others.

Fragment-replicate by estimated load. Loads of keys are counted with map-side combining.
Keys above a quarter of a task's fair load, at most four times as many as there are tasks,
are split into shards in proportion to their load; all other keys are hashed to buckets.
Shards and buckets are bin-packed to tasks, the largest first, each to the task with the
least load so far. Rows go straight to the task of their shard, and rows of a matching
side are copied only to the tasks that hold a shard of their key.

Joins and aggregates on ``(task, key)`` then run where the rows lie: Spark recognises the
partitioning by task number and adds no further exchange.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import discard, durable

#: Buckets of light keys and most heavy keys, for each task.
BUCKETS_PER_TASK, HEAVY_PER_TASK = 16, 4
#: Rows, and characters of keys, of a matching side that may be broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 8_000_000


@dataclass(frozen=True)
class FragmentPlan:
    """Which tasks hold which keys. Both maps are bounded by a multiple of ``tasks``."""

    tasks: int
    heavy: DataFrame
    light: DataFrame
    loads: dict[int, float]
    total: int


def _bucket(key: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS_PER_TASK * tasks)).cast("int")


def pack_units(units: list[tuple[object, int, float]], tasks: int) -> tuple[dict[object, list[int]], dict[int, float]]:
    """Assign ``(name, shards, load)`` to tasks, the largest shard first, to the least loaded task.

    Shards of one name go to different tasks while there are enough of them.
    """
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict[object, list[int]] = {}
    for name, shards, load in sorted(units, key=lambda u: (-u[2] / u[1], str(u[0]))):
        taken = []
        for _ in range(shards):
            if not heap:
                for x in taken:
                    heapq.heappush(heap, x)
                taken = []
            used, t = heapq.heappop(heap)
            placed.setdefault(name, []).append(t)
            taken.append((used + load / shards, t))
        for x in taken:
            heapq.heappush(heap, x)
    return placed, {t: used for used, t in heap}


def plan_fragments(df: DataFrame, key: str, tasks: int | None = None, loads: DataFrame | None = None) -> FragmentPlan:
    """Count loads and place keys. A null key is a key of its own.

    ``loads`` with ``key`` and ``n``, cheap to read several times, saves the counting.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = durable(df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")), "loads") if loads is None else None
    loads = loads if counted is None else counted
    total = loads.agg(F.sum("n")).first()[0] or 0
    limit = total / (HEAVY_PER_TASK * tasks)
    # fewer than HEAVY_PER_TASK * tasks keys can exceed the limit, and there are as many buckets as said above
    heavy = [(r["key"], r["n"]) for r in loads.where(F.col("n") > limit).collect()]
    light = loads.where(F.col("n") <= limit).groupBy(_bucket(F.col("key"), tasks).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    key_type = loads.schema["key"].dataType.simpleString()
    if counted is not None:
        discard(counted)
    share = max(1.0, total / tasks)
    units = [(("heavy", i), min(tasks, math.ceil(2 * n / share)), float(n)) for i, (_, n) in enumerate(heavy)]
    units += [(("light", r["bucket"]), 1, float(r["n"])) for r in light]
    placed, used = pack_units(units, tasks)
    heavy_table = spark.createDataFrame([(k, placed["heavy", i]) for i, (k, _) in enumerate(heavy)], f"key {key_type}, tasks array<int>")
    light_table = spark.createDataFrame([(r["bucket"], placed["light", r["bucket"]][0]) for r in light], "bucket int, at int")
    return FragmentPlan(tasks, heavy_table, light_table, used, total)


def _tagged(df: DataFrame, key: str, plan: FragmentPlan) -> DataFrame:
    """``df`` with ``_tasks``, the shards' tasks of a heavy key, and ``_at``, the task of a light one."""
    heavy = F.broadcast(plan.heavy.select(F.col("key").alias("_key"), F.col("tasks").alias("_tasks")))
    light = F.broadcast(plan.light.select(F.col("bucket").alias("_bucket"), F.col("at").alias("_at")))
    out = df.join(heavy, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_bucket", _bucket(F.col(key), plan.tasks))
    # a key of a matching side may have no rows on the planned side; any task will do
    return out.join(light, "_bucket", "left").withColumn("_at", F.coalesce("_at", F.pmod("_bucket", F.lit(plan.tasks)))).drop("_key", "_bucket")


def place(df: DataFrame, key: str, plan: FragmentPlan, spread: list[str]) -> DataFrame:
    """Rows of the planned side in their tasks, with the column ``_task``.

    Rows of a heavy key are spread over its shards by the hash of the ``spread`` columns, so
    rows that agree in them stay together and a repeated attempt places them alike.
    """
    shard = F.col("_tasks")[F.pmod(F.xxhash64(*spread), F.size("_tasks")).cast("int")]
    tagged = _tagged(df, key, plan).withColumn("_task", F.coalesce(F.when(F.col("_tasks").isNotNull(), shard), F.col("_at")).cast("int"))
    return tagged.drop("_tasks", "_at").repartitionById(plan.tasks, "_task")


def replicate(df: DataFrame, key: str, plan: FragmentPlan) -> DataFrame:
    """Rows of a matching side, copied to each task that holds a shard of their key."""
    tagged = _tagged(df, key, plan).withColumn("_task", F.explode(F.coalesce(F.array_distinct("_tasks"), F.array("_at"))))
    return tagged.withColumn("_task", F.col("_task").cast("int")).drop("_tasks", "_at").repartitionById(plan.tasks, "_task")


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", tasks: int | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Join ``left``, whose keys may be very uneven, with ``right`` on ``key``.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Null keys match nothing, as
    in any equi-join. Other columns that both sides have must be renamed before. The result
    keeps ``_task``, so an aggregate on ``(_task, key)`` follows without an exchange.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is replicated, so a {how} join isn't possible")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    plan = plan or plan_fragments(left, key, tasks)
    return place(left, key, plan, spread).join(replicate(right, key, plan), ["_task", key], how)


def uneven_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", loads: DataFrame | None = None) -> DataFrame:
    """Join ``left``, whose keys may be very uneven, with ``right``, where ``key`` comes once; neither side gathers a key in one task.

    ``right``, cheap to read twice, is broadcast if it is counted to be small, which moves no
    row of ``left``; otherwise ``left`` is placed by load. ``right`` may have a few columns of
    fixed size besides ``key``, a string or a number.
    """
    rows, chars = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        return left.join(F.broadcast(right), key, how)
    return fragment_replicate_join(left, right, key, spread, how, plan=plan_fragments(left, key, loads=loads)).drop("_task")


def fragment_aggregate(placed: DataFrame, key: str, partial: list[Column], final: list[Column]) -> DataFrame:
    """Per-key results of placed rows: ``partial`` where they lie, then ``final`` over one row for each shard."""
    return placed.groupBy("_task", key).agg(*partial).groupBy(key).agg(*final)


def term_results(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """Results of each term of an inverted index, however uneven its terms are.

    ``term`` (lower case, no blanks around), ``total_rows`` (all rows, repeated ones too),
    ``records`` (distinct, null ones left out), ``positions`` (postings held by all rows),
    ``per_record`` (rows for each record, null without records), ``share`` of all rows with a
    term, and ``heavy`` for a share of 1 percent or more. Rows with a null term are left out; null postings hold nothing; a blank
    term is a term. Other columns are ignored. An empty index has no terms.
    """
    rows = index.select(F.lower(F.trim("term")).alias("term"), "doc_id", F.coalesce(F.size("postings"), F.lit(0)).alias("held")).where("term is not null")
    plan = plan_fragments(rows, "term", tasks)
    # fewer than HEAVY_PER_TASK for each task; others have too few rows to fill one, however often they are repeated
    limit = plan.total / (HEAVY_PER_TASK * plan.tasks)
    heavy = [r[0] for r in rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("doc_id").collect()]
    wide = F.col("doc_id").isin(heavy) if heavy else F.lit(False)
    # rows of one term and record share a shard, so distinct records add up; those without a
    # record, or with one that has very many rows, are spread by their place
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull() | wide, F.monotonically_increasing_id()))
    each = place(salted, "term", plan, ["doc_id", "salt"]).groupBy("_task", "term", "doc_id").agg(F.sum(F.greatest("held", F.lit(0))).alias("held"), F.count(F.lit(1)).alias("rows"))
    partial = [F.count(F.when(~wide, F.col("doc_id"))).alias("records"), F.sum("held").alias("positions"), F.sum("rows").alias("total_rows")]
    records = F.sum("records")
    if heavy:  # a wide record may be in several shards of a term, so these few are counted by name
        partial.append(F.collect_set(F.when(wide, F.col("doc_id"))).alias("names"))
        records += F.size(F.array_distinct(F.flatten(F.collect_list("names"))))
    out = fragment_aggregate(each, "term", partial, [records.alias("records"), F.sum("positions").alias("positions"), F.sum("total_rows").alias("total_rows")])
    return out.select("term", "total_rows", "records", "positions", F.round(F.when(F.col("records") > 0, F.col("total_rows") / F.col("records")), 6).alias("per_record"), F.round(F.col("total_rows") / F.lit(max(plan.total, 1)), 6).alias("share"), (F.col("total_rows") * 100 >= plan.total).alias("heavy"))
