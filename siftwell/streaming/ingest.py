"""Documents from a stream into an index: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftwell.sources.index import Index, MergePolicy


def ingest(stream: DataFrame, index: Index, checkpoint: str, policy: MergePolicy | None = None, **trigger) -> StreamingQuery:
    """Adds every micro-batch of stream to index; with a policy, segments are merged after each.

    A batch whose number is marked as done is skipped when the stream replays it. A failure between commit and mark adds
    the batch again: delivery is at least once.
    """
    done = f"{index.path}/batches"

    def put(batch: DataFrame, number: int) -> None:
        mark = f"{done}/{number}.json"
        if index.files.exists(mark):
            return
        index.rollback()
        index.add(batch)
        index.commit()
        index.files.publish(mark, "{}")
        if policy is not None:
            index.auto_merge(policy)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
