"""Changes from streams: each micro-batch of quads is added to or removed from a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fourfold.folders import checkpointed
from fourfold.schema import QUAD
from fourfold.store import QuadStore


def import_stream(store: QuadStore, stream: DataFrame, checkpoint: str | None = None, commit: bool = False) -> StreamingQuery:
    """Adds the quads of a stream, and the quoted triples in them; ends when what is there by now is in. A batch that comes
    again changes nothing."""
    return started(stream, lambda batch: store.add(batch), store, checkpoint, commit)


def remove_stream(store: QuadStore, stream: DataFrame, checkpoint: str | None = None, commit: bool = False) -> StreamingQuery:
    """Removes the quads of a stream."""
    return started(stream, lambda batch: store.remove(batch), store, checkpoint, commit)


def change_stream(store: QuadStore, stream: DataFrame, checkpoint: str | None = None, commit: bool = False) -> StreamingQuery:
    """Changes of a stream with the columns seq and op (add or remove): of a batch's changes of a quad the latest counts."""

    def change(batch: DataFrame) -> None:
        last = batch.groupBy(*QUAD).agg(F.max_by("op", "seq").alias("op"))
        store.remove(last.where("op = 'remove'"))
        store.add(last.where("op = 'add'"))

    return started(stream, change, store, checkpoint, commit)


def started(stream: DataFrame, apply, store: QuadStore, checkpoint: str | None, commit: bool) -> StreamingQuery:
    def each(batch: DataFrame, _: int) -> None:
        # The batch is gone when this returns, so its rows, and no others, are written to the shared folder.
        apply(checkpointed(batch))
        if commit:
            store.commit()

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
