"""A log of changes as a stream: (seq, kind, element_id), batched and applied to a table of elements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import shared_dir

KINDS = ("node_added", "node_removed", "edge_added", "edge_removed", "updated")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of changes, by its file; kinds are the event types."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("element_id"), "value")


def only(changes: DataFrame, *kinds: str) -> DataFrame:
    """A subscription to some kinds of changes."""
    return changes.where(F.col("kind").isin(list(kinds)))


def last_states(batch: DataFrame) -> DataFrame:
    """One row for each element: its last change in the batch, by seq, and how many there were."""
    return batch.groupBy("element_id").agg(F.max(F.struct("seq", "kind", "value")).alias("m"), F.count(F.lit(1)).alias("n")).select("element_id", "m.seq", "m.kind", "m.value", "n")


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The versions in a folder that were written to their end, by the batch that made them."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
    done = [x for x in names if x.startswith("version-") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS"))]
    return {int(x.removeprefix("version-")): f"{folder}/{x}" for x in done}


def applied_batch(batch: DataFrame, number: int, folder: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Merges a micro-batch with the newest version from before it and writes the result as the version of its number.

    What it reads depends on the folder alone, so a batch that is run again, in this process or after a restart, reads
    what it read the first time and writes the same rows.
    """
    before = {k: path for k, path in versions(batch.sparkSession, folder).items() if k < number}
    old = batch.sparkSession.read.parquet(before[max(before)]) if before else None
    merge(old, batch).write.mode("overwrite").parquet(f"{folder}/version-{number}")


def applied(changes: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Runs the stream to its end; each micro-batch is merged with the table so far and written as a new version.

    Versions are never changed by later batches, so the one before is the undo state. With a folder of an earlier run
    the stream goes on where that run ended.
    """
    spark = changes.sparkSession
    folder = folder or f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        applied_batch(batch, number, folder, merge)

    run = changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    made = versions(spark, folder)
    if not made:
        return merge(None, spark.createDataFrame([], changes.schema))
    return spark.read.parquet(made[max(made)])


def merge_last(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The last change of each element over all batches so far."""
    new = last_states(batch)
    if old is None:
        return new
    return old.unionByName(new).groupBy("element_id").agg(F.max(F.struct("seq", "kind", "value")).alias("m"), F.sum("n").alias("n")).select("element_id", "m.seq", "m.kind", "m.value", "n")
