"""Structured Streaming: continuous folds and matching of a stream against the current version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fold import fold
from ..operators.match import fold_events
from ..plans.build import publish_fold
from ..plans.store import Store


def fold_stream(contrib: DataFrame, root: str, feed: str, clock, checkpoint: str, seconds: int = 300, available_now: bool = False):
    """Folds a stream of contributions, one version each trigger. The state of the feed names the stream (by its checkpoint) and its last
    batch, so a batch that comes again changes nothing; generations go on from whatever the feed has reached."""
    spark: SparkSession = contrib.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        store = Store(spark, root)
        before = store.open(check=True)
        done = fold(before.state, [batch], feed, clock(), stream=checkpoint, batch=number)
        if done.applied:
            publish_fold(store, before, done)

    writer = contrib.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def match_stream(observed: DataFrame, value_col: str, event_col: str, root: str, sink, checkpoint: str, skip_private: bool = False, available_now: bool = False):
    """Matches each micro-batch against the version that is current when it starts; sink(events, number) gets one row for each event."""

    def one(batch: DataFrame, number: int) -> None:
        sink(fold_events(Store(batch.sparkSession, root).open(strict=False).lookup(batch, value_col, skip_private), event_col), number)

    writer = observed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
