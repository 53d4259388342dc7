"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def local_session(name: str = "loomgraph", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions)}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Local sessions get a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own_folders[context.applicationId]


def written(df: DataFrame, label: str, *partition_by: str) -> str:
    """Writes the rows as Parquet into the shared folder; the path."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back.

    The result has no lineage, so a lost executor costs one read of a file and never a recomputation of what led there.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table (or one partition of it) that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame, label: str, condition: str = "true") -> tuple[DataFrame, int]:
    """Like materialize, with the number of rows that meet a condition, counted while they are written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), label)
    return table, seen.get["n"]


#: Rows of a table that one task groups.
ROWS = 500_000


def tasks_for(rows: int) -> int:
    """Tasks over which a table of some rows is dealt, so that none grows with it; 0: one would do, so it is left to Spark."""
    return -(-rows // ROWS) if rows > ROWS else 0


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over a number of tasks that nothing makes smaller; 0: as they are."""
    return df.repartition(tasks, *keys) if tasks else df


class Rounds:
    """A table that a loop writes anew in each round: put gives the new version and deletes the one before it."""

    def __init__(self, label: str):
        self.label, self.path = label, None

    def put(self, df: DataFrame) -> DataFrame:
        path = written(df, self.label)
        if self.path:
            remove(df.sparkSession, self.path)
        self.path = path
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, condition: str) -> tuple[DataFrame, int]:
        """The new version, and how many of its rows meet a condition."""
        seen = Observation()
        table = self.put(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
        return table, seen.get["n"]


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets Arrow batches of this session hold no more than some bytes, so that long texts do not add up in a task's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > size:
        spark.conf.set(key, str(size))
