"""A search engine over stored indexes: the seven calls of an index's life, and queries that answer in JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .config import IndexConfig
from .functions.analyze import CLEAN, Analyzer
from .operators.index import Index
from .operators.measure import searcher
from .operators.search import results_json
from .operators.shelf import Shelf
from .ship import ship

Documents = DataFrame | Iterable[tuple[str, str]]


class SearchEngine:
    """Documents are a DataFrame ``doc_id``, ``content``, or pairs of both."""

    def __init__(self, spark: SparkSession, root: str, config: IndexConfig | None = None, analyzer: Analyzer = CLEAN):
        ship(spark)
        self.spark, self.config, self.analyzer = spark, config or IndexConfig(), analyzer
        self.shelf = Shelf(spark, f"{root.rstrip('/')}/{self.config.short_id}", self.config)
        self.index: Index | None = None

    def _frame(self, docs: Documents) -> DataFrame:
        return docs if isinstance(docs, DataFrame) else self.spark.createDataFrame(list(docs), "doc_id string, content string")

    def create_index(self, index_id: str, files: Documents) -> None:
        self.index = self.shelf.create(index_id, self._frame(files), self.analyzer)

    def load_index(self, index_id: str) -> None:
        self.index = self.shelf.load(index_id, self.analyzer)

    def update_index(self, index_id: str, remove_files: Iterable[str] | DataFrame | None = None, add_files: Documents | None = None) -> None:
        """Remove, then add; an added document replaces one of the same id."""
        if remove_files is not None and not isinstance(remove_files, DataFrame):
            remove_files = self.spark.createDataFrame([(x,) for x in remove_files], "doc_id string")
        added = None if add_files is None else self._frame(add_files)
        self.index = self.shelf.update(index_id, remove_files, added, self.analyzer)

    def search(self, query: str) -> DataFrame:
        """``doc_id`` and ``score``, best first."""
        if self.index is None:
            raise RuntimeError("create or load an index first")
        return searcher(self.config)(self.index, query)

    def query(self, query: str) -> str:
        """The results as a JSON array of objects with ``doc_id`` and ``score``."""
        return results_json(self.search(query), self.config.most_hits).first()["json"]

    def delete_index(self, index_id: str) -> None:
        self.shelf.delete(index_id)
        self.index = None

    def list_indices(self) -> list[str]:
        return self.shelf.list()

    def list_indexed_files(self, index_id: str) -> DataFrame:
        return self.shelf.list_files(index_id)
