"""Sinks for batches of streams that have no transactions of their own.

A batch is written in full to a folder beside its target, with a manifest of its files, and then published by one rename to
a name that tells the writer and the number of the batch. The rename either happens or not, and fails if the name is taken;
a batch that is run again after a failure finds its name taken, or leaves its unpublished folder behind. So readers see each
batch whole, once. The file system must rename folders in one step (HDFS and local ones do, object stores do not).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.config import EngineConfig
from tidemark.operators import store
from tidemark.operators.decode import wanted_channels
from tidemark.streaming.keyed import started

MANIFEST = "_manifest.json"
#: The topic of messages that are no events.
ERRORS = "deserialization-errors"


def broker_rows(results: DataFrame) -> DataFrame:
    """key (the pool) and value (the row as JSON with nulls written out)."""
    return results.select(F.col("pairAddress").alias("key"), F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value"))


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(path: str, writer: str, n: int) -> str:
    return f"{path.rstrip('/')}/{writer}-{n:012d}"


def _staging(path: str) -> str:
    return f"{path.rstrip('/')}_staged"


def stage(rows: DataFrame, n: int, path: str, writer: str) -> str:
    """Writes a batch, which no reader sees yet; the folder."""
    spark = rows.sparkSession
    folder = f"{_staging(path)}/{writer}-{n}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    where, fs = _path(spark, folder)
    files = [{"name": f.getPath().getName(), "bytes": f.getLen()} for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
    out = fs.create(_path(spark, f"{folder}/{MANIFEST}")[0], False)
    out.write(bytearray(json.dumps({"writer": writer, "batch": n, "files": files}).encode()))
    out.close()
    return folder


def publish(spark: SparkSession, folder: str, n: int, path: str, writer: str) -> None:
    """Makes a staged batch visible by one rename, which fails if the batch is there already."""
    source, fs = _path(spark, folder)
    target, _ = _path(spark, _published(path, writer, n))
    fs.mkdirs(target.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), none)


def commit(rows: DataFrame, n: int, path: str, writer: str) -> bool:
    """Publishes a batch unless it is there already; whether it was published now."""
    spark = rows.sparkSession
    where, fs = _path(spark, _published(path, writer, n))
    if fs.exists(where):
        return False
    publish(spark, stage(rows, n, path, writer), n, path, writer)
    return True


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows that have been published."""
    where, fs = _path(spark, path)
    found = fs.exists(where) and len(fs.listStatus(where)) > 0
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/*") if found else spark.createDataFrame([], schema)


def committed_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """The batches of a target as a stream, from the first on."""
    where, fs = _path(spark, path)
    fs.mkdirs(where)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path.rstrip('/')}/*")


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes what failed attempts have left; only while no writer is at work. The number of folders."""
    where, fs = _path(spark, _staging(path))
    return sum(bool(fs.delete(f.getPath(), True)) for f in fs.listStatus(where)) if fs.exists(where) else 0


def start_committed(results: DataFrame, path: str, checkpoint: str, writer: str = "stream", **trigger) -> StreamingQuery:
    """A stream whose batches are published exactly once, restarts included."""
    return started(results, results.writeStream.outputMode("append").foreachBatch(lambda batch, n: commit(batch, n, path, writer)), checkpoint, trigger)


def start_topic(results: DataFrame, path: str, checkpoint: str, writer: str = "stream", **trigger) -> StreamingQuery:
    """Result rows as messages (key and JSON value) of a topic that is a folder, each exactly once."""
    return start_committed(broker_rows(results), path, checkpoint, writer, **trigger)


#: Frames of a bus: the batch that brought them and their place in it.
FRAMES = "channel string, pair string, frame string, batch long, at long"


def start_bus(frames: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Frames for live clients (channel, pair, frame) as a bus that anyone can join at any time."""
    numbered = lambda batch, n: batch.select("channel", "pair", "frame", F.lit(n).cast("long").alias("batch"), F.monotonically_increasing_id().alias("at"))
    return started(frames, frames.writeStream.outputMode("append").foreachBatch(lambda batch, n: commit(numbered(batch, n), n, path, "bus")), checkpoint, trigger)


def subscribe(spark: SparkSession, path: str, message: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the last frame of the bus, all frames after it as a stream), of the channels that a client's message names.

    The last frame is left out if it is of another channel. Only the latest batch that has frames is read for it.
    """
    where, fs = _path(spark, path)
    schema = spark.createDataFrame([], FRAMES).schema
    wanted = F.col("channel").isin(*wanted_channels(message))
    names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
    last = None
    while names and last is None:
        last = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{names.pop()}").orderBy(F.desc("at")).first()
    old = spark.createDataFrame([last] if last is not None else [], schema).where(wanted)
    return old, committed_stream(spark, path, schema).where((F.col("batch") > (-1 if last is None else last["batch"])) & wanted)


def result_store(base: str, config: EngineConfig, now=None):
    """A sink for start_engine that keeps each topic as a stored table under base, counts what it brings, and trims what is older
    than the settings keep. now: a function that gives milliseconds; without one, nothing is trimmed."""

    def sink(rows: DataFrame, n: int, topic: str) -> None:
        if topic == ERRORS:
            commit(rows, n, f"{base}/{topic}", "errors")
            return
        score = "detectedAt" if topic == "pattern-analytics" else "windowStart"
        hours = config.liquidity_retention_hours if topic.startswith("liquidity") else config.trading_retention_hours
        store.write_results(rows, f"{base}/{topic}", score, (topic, n), (now(), hours) if now else None)

    return sink
