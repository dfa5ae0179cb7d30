"""Keep a stored index up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analyze import CLEAN, Analyzer
from ..operators.shelf import Shelf


def index_stream(docs: DataFrame, shelf: Shelf, index_id: str, checkpoint: str, analyzer: Analyzer = CLEAN) -> StreamingQuery:
    """Each micro-batch of ``doc_id``, ``content`` becomes a new version of the index.

    A batch is written as one segment, so what is stored already is not written again. A
    repeated batch replaces its own documents, and of several rows of one document the greatest
    content counts, so a restart after a failure gives the same index. Null ids are left out.
    Runs until all available input is taken.
    """

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max("content").alias("content"))
        if shelf.versions(index_id):
            shelf.update(index_id, add=batch, analyzer=analyzer)
        else:
            shelf.create(index_id, batch, analyzer)

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
