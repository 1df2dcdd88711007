"""Stream sources and a sink for keyed updates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from codexfold.operators.events import EVENT_TYPE, event_decode

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Bounds what one session can bring into a task per micro-batch; use the batch
# operators to work off a long history.
BYTES_PER_TRIGGER = 1024 * 1024 * 1024
CLOSED = "9999-01-01 00:00:00"  # later than any event


def stream_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep their state in RocksDB, off the
    executors' heap, with changelog checkpoints; the caller's settings stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder below the cluster's ``spark.checkpoint.dir``; a local session
    without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="codexfold-")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def with_close(events: DataFrame, folder: str) -> DataFrame:
    """``events`` and the markers in ``folder``: rows of a time alone, no session."""
    spark = events.sparkSession
    spark.createDataFrame([], "marked string").coalesce(1).write.mode("append").parquet(folder)
    marks = spark.readStream.schema("marked string").parquet(folder)
    kind = dict(events.dtypes)["ts"]
    return events.unionByName(marks.select(F.col("marked").cast(kind).alias("ts")), allowMissingColumns=True)


def close_log(spark: SparkSession, folder: str, after: str = CLOSED) -> None:
    """Marks that no event before ``after`` is still to come."""
    spark.createDataFrame([(after,)], "marked string").coalesce(1).write.mode("append").parquet(folder)


def read_event_lines(spark: SparkSession, location: str, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """Events of a folder of JSON-lines files; invalid lines are dropped."""
    lines = (
        spark.readStream.option("maxBytesPerTrigger", bytes_per_trigger).text(location)
        .select(F.col("value").alias("line"))
    )
    return event_decode(lines, EVENT_TYPE).where("valid").select("event.*")


def read_table_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    files: str = "*.parquet",
    bytes_per_trigger: int = BYTES_PER_TRIGGER,
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", files)
        .option("maxBytesPerTrigger", bytes_per_trigger).parquet(folder)
    )


def write_updates(stream: DataFrame, location: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each micro-batch to its own partition of a parquet table.

    A batch that is repeated after a failure overwrites its own partition, so
    the table holds every batch exactly once.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of a table written by ``write_updates``."""
    values = [c for c in table.columns if c not in keys and c != "batch_id"]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_row")
    return table.groupBy(*keys).agg(newest).select(*keys, "_row.*")
