"""Tables that cut lineage.

A durable table is written as Parquet below the shared folder named by
``spark.checkpoint.dir`` and read back, so a lost executor never loses it and the
optimizer sees its true size. Only where the setting is absent (local tests) a
temporary folder is used. All tables of an application lie in one folder of its own.

A table lives until ``discard`` is called for it, the ``scope`` ends in which it was
written, or Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, SparkSession] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder for durable tables; a temporary one only if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="loomtext-"))


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)
        if not any(p.startswith(f"{path.rpartition('/')[0]}/") for p in _written):
            fs.delete(target.getParent(), False)
    except Exception:  # the JVM may already be gone at exit, or the folder hold something else; it is then the cluster's to clean
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        _remove(path)


def durable(df: DataFrame, name: str = "table", codec: str = "zstd", kept: bool = False) -> DataFrame:
    """Write ``df`` once and return a reader of the written table; a ``kept`` one outlives the scope."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomtext-{spark.sparkContext.applicationId}{'-kept' if kept else ''}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove durable tables that nothing will read any more; other frames are left alone."""
    for t in tables:
        if path := _path_of.pop(t, None):
            _remove(path)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Durable tables written inside are removed at the end, so results must be used or written by then.

    What is entered is a function that excepts a table; an outer scope still ends it.
    """
    before = set(_written)
    spared: set[str] = set()

    def spare(table: DataFrame) -> DataFrame:
        spared.add(_path_of[table])
        return table

    try:
        yield spare
    finally:
        for path in [p for p in _written if p not in before | spared and "-kept/" not in p]:
            _remove(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores.

    A few small files would otherwise keep all work that follows on a few tasks. Input of
    cluster size has more partitions than cores and is left as it is, and so is what comes
    out of a shuffle: its partitions are the shuffle's, and asking an adaptive plan for their
    number would run its stages.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
