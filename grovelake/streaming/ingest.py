"""Micro-batches of changes, each committed once to a store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_stream(stream: DataFrame, store, checkpoint: str, namespace: str = "default", **trigger):
    """Starts a query that commits each micro-batch of (key, value, is_delete, seq); what is staged stays.

    Commits carry the last batch of each stream on their branch, written with the data: a batch that is replayed
    after a failure is left out, however many other commits came in between.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        if store.last_batch(checkpoint) < batch_id:
            changes = batch.select("key", "value", F.coalesce("is_delete", F.lit(False)).alias("is_delete"), "seq")
            store.commit_changes(changes, f"batch {batch_id} of {checkpoint}", namespace, {checkpoint: batch_id})

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
