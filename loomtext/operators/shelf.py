"""Indexes on disk: versions made of segments, their layouts, and updates that write only what is new.

A version is a small file, written last, that names the segments of postings it reads and
the tables of its own: ``term_stats``, ``doc_catalog`` (each document with the segment that
holds it) and ``gone`` (documents that a segment still holds but the version doesn't).
Readers take the newest version, so an update never disturbs them, and a failed one leaves
nothing to repair. One writer at a time is assumed. An update writes one segment with the added documents; segments are merged
when there are more than ``MOST_SEGMENTS``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARQUET, IndexConfig, Info, Optimization, Store
from ..durable import discard, durable
from ..functions.analyze import CLEAN, Analyzer
from .index import Index, build, doc_lengths, document_frequency, indexed_files, skip_targets, with_lengths
from .skew import BROADCAST_CHARS, BROADCAST_ROWS

#: Segments that a version may have before an update merges them.
MOST_SEGMENTS = 8
#: Columns of stored postings, by what they hold; what is missing is derived when read.
LAYOUTS = {
    Info.BOOLEAN: ["term", "doc_id", "positions"],
    Info.WORDCOUNT: ["term", "doc_id", "term_count", "positions"],
    Info.TFIDF: ["term", "doc_id", "term_count", "positions", "doc_len"],
}
_ORDER = {"postings": ["term", "doc_id"], "term_stats": ["term"], "doc_catalog": ["doc_id"], "gone": ["doc_id"]}


def _few(df: DataFrame) -> DataFrame:
    """``df`` of ``doc_id`` with a broadcast hint if it is counted to be small."""
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("doc_id")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


class Shelf:
    """Stored indexes below a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, config: IndexConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or IndexConfig()

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self, index_id: str) -> list[str]:
        """Complete versions, oldest first."""
        return [v for v in self._names(index_id) if v.startswith("v") and self._fs().exists(self._path(index_id, v, "version.json"))]

    def _version(self, index_id: str, version: str) -> dict:
        stream = self._fs().open(self._path(index_id, version, "version.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self, index_id: str) -> str:
        found = self.versions(index_id)
        if not found:
            raise FileNotFoundError(f"no index {index_id} below {self.root}")
        return found[-1]

    # Segments

    def _table_name(self, index_id: str, segment: str) -> str:
        """Name of a segment in the catalog: one for each root, index and segment."""
        place = zlib.crc32(f"{self._path(index_id).makeQualified(self._fs().getUri(), self._fs().getWorkingDirectory())}".encode())
        clean = "".join(c if c.isalnum() and c.isascii() else "_" for c in index_id.lower())
        return f"loomtext_{clean}_{place:08x}_{segment}"

    def _write_segment(self, index_id: str, postings: DataFrame) -> dict:
        """Write postings in the configured layout; what a version says of the segment."""
        segment = f"s{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{index_id}/{segment}"
        columns = list(LAYOUTS[self.config.info])
        options = PARQUET[self.config.codec]
        if self.config.optimization is Optimization.SKIPPING:
            postings, columns = skip_targets(postings), [*columns, "ordinal", "skip_to"]
        out = postings.select(columns)
        about = {"name": segment, "gone": 0}
        if self.config.store is Store.DB1:
            # buckets by term let joins and groups on the term run without an exchange
            about["buckets"] = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            out.write.mode("overwrite").options(**options).option("path", path).bucketBy(about["buckets"], "term").sortBy("term").saveAsTable(self._table_name(index_id, segment))
        else:
            out.repartitionByRange(*_ORDER["postings"]).sortWithinPartitions(*_ORDER["postings"]).write.options(**options).parquet(path)
        return about

    def _segment(self, index_id: str, about: dict) -> DataFrame:
        """Postings of one segment, from its catalog table if it has one."""
        path = f"{self.root}/{index_id}/{about['name']}"
        if "buckets" not in about:
            return self.spark.read.parquet(path)
        name = self._table_name(index_id, about["name"])
        if not self.spark.catalog.tableExists(name):  # a session with another catalog
            columns = self.spark.read.parquet(path).schema.toDDL()
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _live(self, index_id: str, version: str, about: dict) -> DataFrame:
        """Postings of a segment whose documents the version still has there."""
        rows = self._segment(index_id, about)
        if not about["gone"]:
            return rows
        gone = self.spark.read.parquet(f"{self.root}/{index_id}/{version}/gone").where(F.col("segment") == about["name"]).select("doc_id")
        return rows.join(F.broadcast(gone) if about["gone"] <= BROADCAST_ROWS // 4 else gone, "doc_id", "left_anti")

    # Versions

    def _write_version(self, index_id: str, segments: list[dict], tables: dict[str, DataFrame]) -> str:
        """Write a version's tables, then its file; drop all versions but the one before it, and segments of none."""
        numbers = [int(v[1:]) for v in self._names(index_id) if v.startswith("v")]
        version = f"v{max(numbers, default=-1) + 1:06d}"
        for table, df in tables.items():
            key = _ORDER[table]
            df.repartitionByRange(*key).sortWithinPartitions(*key).write.options(**PARQUET[self.config.codec]).parquet(f"{self.root}/{index_id}/{version}/{table}")
        text = json.dumps({"config": self.config.short_id, "info": self.config.info.name, "segments": segments})
        out = self._fs().create(self._path(index_id, version, "version.json"), False)
        out.write(bytearray(text.encode()))
        out.close()
        self._tidy(index_id)
        return f"{self.root}/{index_id}/{version}"

    def _tidy(self, index_id: str) -> None:
        kept = self.versions(index_id)[-2:]
        used = {s["name"] for v in kept for s in self._version(index_id, v)["segments"]}
        for name in self._names(index_id):
            if name in kept or name in used:
                continue
            if name.startswith("v") and name > kept[-1]:
                continue  # being written
            self._drop(index_id, name)

    def _drop(self, index_id: str, name: str) -> None:
        if name.startswith("s") and self.config.store is Store.DB1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(index_id, name)}")
        self._fs().delete(self._path(index_id, name), True)

    def save(self, index: Index, index_id: str) -> str:
        """Write an index as one segment of a new version; statistics come from what was written."""
        postings = with_lengths(index, index.postings)
        if self.config.info is Info.TFIDF:
            about, staged = self._write_segment(index_id, postings), None
            postings = self._segment(index_id, about)
        else:
            postings = staged = durable(postings, "postings")
            about = self._write_segment(index_id, postings)
        catalog = doc_lengths(postings, index.doc_catalog.select("doc_id")).withColumn("segment", F.lit(about["name"]))
        base = self._write_version(index_id, [about], {"term_stats": document_frequency(postings), "doc_catalog": catalog})
        if staged is not None:
            discard(staged)
        return base

    def create(self, index_id: str, docs: DataFrame, analyzer: Analyzer = CLEAN) -> Index:
        """Build and save; an index of that name is replaced."""
        self.save(build(docs, analyzer), index_id)
        return self.load(index_id, analyzer)

    def load(self, index_id: str, analyzer: Analyzer = CLEAN) -> Index:
        """The newest version, whatever layout it was stored in."""
        version = self._newest(index_id)
        about = self._version(index_id, version)
        columns = list(LAYOUTS[Info[about["info"]]])
        parts = [self._live(index_id, version, s) for s in about["segments"]]
        extra = ["ordinal", "skip_to"] if all("skip_to" in p.columns for p in parts) else []
        postings = reduce(DataFrame.unionByName, [p.select([*columns, *extra]) for p in parts])
        if "term_count" not in columns:
            postings = postings.withColumn("term_count", F.size("positions"))
        stats, catalog = (self.spark.read.parquet(f"{self.root}/{index_id}/{version}/{t}") for t in ("term_stats", "doc_catalog"))
        return Index(postings, stats, catalog.select("doc_id", "doc_len"), analyzer)

    def update(self, index_id: str, remove: DataFrame | None = None, add: DataFrame | None = None, analyzer: Analyzer = CLEAN) -> Index:
        """Remove documents (``doc_id``), then add ``doc_id``, ``content``; an added one replaces its old version.

        Postings already stored are read, to take removed ones from the frequencies, and not
        written again unless segments are merged.
        """
        version = self._newest(index_id)
        about = self._version(index_id, version)
        fresh = build(add, analyzer).stored(durable) if add is not None else None
        ids = [x.select(F.col("doc_id").cast("string").alias("doc_id")) for x in (remove, fresh and fresh.doc_catalog) if x is not None]
        if not ids:
            return self.load(index_id, analyzer)
        wanted = durable(reduce(DataFrame.unionByName, ids).where("doc_id is not null").distinct(), "wanted")
        few = _few(wanted)
        old = self.load(index_id, analyzer)
        lost = old.postings.select("term", "doc_id").join(few, "doc_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        changes = old.term_stats.unionByName(lost.withColumn("df", -F.col("df")))
        if fresh is not None:
            changes = changes.unionByName(fresh.term_stats)
        stats = durable(changes.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), "term-stats")
        base = f"{self.root}/{index_id}/{version}"
        catalog = self.spark.read.parquet(f"{base}/doc_catalog")
        left = catalog.join(few, "doc_id", "left_semi").select("doc_id", "segment")
        if any(s["gone"] for s in about["segments"]):
            left = left.unionByName(self.spark.read.parquet(f"{base}/gone"))
        left = durable(left, "gone")
        counts = {r["segment"]: r["n"] for r in left.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_SEGMENTS rows
        segments = [s | {"gone": counts.get(s["name"], 0)} for s in about["segments"]]
        stays = catalog.join(few, "doc_id", "left_anti")
        if fresh is not None:
            segments.append(self._write_segment(index_id, fresh.postings))
            stays = stays.unionByName(fresh.doc_catalog.select("doc_id", "doc_len", F.lit(segments[-1]["name"]).alias("segment")))
        self._write_version(index_id, segments, {"term_stats": stats, "doc_catalog": stays, "gone": left})
        discard(wanted, stats, left)
        if fresh is not None:
            discard(fresh.postings, fresh.term_stats, fresh.doc_catalog)
        if len(segments) > MOST_SEGMENTS:
            self.save(self.load(index_id, analyzer), index_id)
        return self.load(index_id, analyzer)

    def delete(self, index_id: str) -> bool:
        """Whether there was such an index; its catalog tables go too."""
        for name in self._names(index_id):
            self._drop(index_id, name)
        return self._fs().delete(self._path(index_id), True)

    def list(self) -> list[str]:
        """Names of the indexes that have a complete version."""
        return [i for i in self._names() if self.versions(i)]

    def list_files(self, index_id: str) -> DataFrame:
        return indexed_files(self.load(index_id))

    def size_mb(self, index_id: str) -> float:
        """Megabytes of the newest version and its segments, from the file system's own count."""
        version = self._newest(index_id)
        parts = [version, *(s["name"] for s in self._version(index_id, version)["segments"])]
        return sum(self._fs().getContentSummary(self._path(index_id, p)).getLength() for p in parts) / 2**20
