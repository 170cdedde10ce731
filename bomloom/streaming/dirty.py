"""Marks of changed materials from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bomloom.operators.refresh import merge_marks
from bomloom.sources.stored import KeyedTable


def stream_marks(changes: DataFrame, marks: KeyedTable, checkpoint: str, repeated_within: str | None = None) -> StreamingQuery:
    """Store the latest mark of each material from a stream of changes (material_id, reason, marked_at), until what is there now is read.

    Each micro-batch is merged into marks by key. Merging is the same in any order and
    any number of times, so however the stream is cut, and whether a batch is repeated
    after a failure, the table is what one batch over everything would make. Rows with a
    null id or time are left out.

    With repeated_within, equal changes within that time are dropped before they reach
    the table, by state that a watermark bounds; changes later than it are lost then.
    """
    clean = changes.select("material_id", "reason", "marked_at").where("material_id IS NOT NULL AND marked_at IS NOT NULL")
    if repeated_within:
        clean = clean.withWatermark("marked_at", repeated_within).dropDuplicatesWithinWatermark(["material_id", "reason", "marked_at"])
    writer = clean.writeStream.foreachBatch(lambda batch, _: merge_marks(marks, batch) if not batch.isEmpty() else None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
