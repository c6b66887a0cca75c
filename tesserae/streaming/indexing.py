"""An index that grows with a stream of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.functions.text import content_tokens
from tesserae.operators import index


def add_batch(passages: DataFrame, batch: int, path: str) -> None:
    """Adds a batch of passages (doc_id, text) to the index at path as the segment of its number.

    A batch that comes again, after a failure between the write and the stream's
    commit, replaces what it wrote before, so the index holds it once.  What a
    segment adds to document frequencies and to the corpus's size is stored with it and
    summed by readers.
    """
    if not passages.isEmpty():
        index.write_segment(passages.select(F.col("doc_id").alias("chunk_id"), content_tokens(F.col("text")).alias("tokens")), path, batch)


def index_stream(passages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts indexing a stream of passages (doc_id, text); every micro-batch is a segment."""
    writer = passages.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
