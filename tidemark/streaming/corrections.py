"""Windows that take back events whose blocks a reorganisation has removed.

A stream of statements brings events as they are found (removed false) and taken back (removed true, with the event as it was).
Sums could be inverted, extremes and first and last prices cannot; so each batch makes the windows that it touches anew from the
events that still stand. It reads the span of time of these windows only, and groups by event, so a hot pool is spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scalars as S
from tidemark.functions.joins import null_safe
from tidemark.streaming import sinks
from tidemark.streaming.keyed import started

#: What names an event; a transaction that is mined again, in another block, makes another.
EVENT = ["eventId", "blockNumber"]
SWAPS, MOVES = ("Swap",), ("Mint", "Burn", "Transfer")


def standing(statements: DataFrame) -> DataFrame:
    """Events that stand: those whose last statement, by the number `stated`, does not remove them; of equal numbers removal wins.

    Repeated statements count once. Events without an eventId cannot be named, so they stand, each of them.
    """
    named = F.col("eventId").isNotNull()
    last = statements.where(named).groupBy(*EVENT).agg(F.max_by(F.struct(*statements.columns), F.struct("stated", "removed")).alias("_last")).select("_last.*")
    return last.unionByName(statements.where(~named)).where("not coalesce(removed, false)").drop("removed", "stated")


def corrected(statements: DataFrame, batch: DataFrame, plan: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...], minutes: int) -> DataFrame:
    """The windows that a batch of statements touches, made of all statements by plan, with `gone`: true (and the other columns
    null) if nothing is left in a window. Statements without an event_time are in no window."""
    keys = ["window", "pairAddress"]
    placed = lambda rows: rows.where(F.col("eventType").isin(*kinds) & F.col("event_time").isNotNull()).withColumn("window", F.window("event_time", f"{minutes} minutes"))
    touched = placed(batch).select(*keys).distinct()
    span = touched.agg(F.min(F.unix_micros("window.start")), F.max(F.unix_micros("window.end"))).first()
    low, high = (F.timestamp_micros(F.lit(x).cast("long")) for x in span)
    near = statements.where((F.col("event_time") >= low) & (F.col("event_time") < high))
    rows = plan(standing(null_safe(placed(near), touched, keys).drop("window")))
    start, end = S.millis(F.col("window.start")), S.millis(F.col("window.end"))
    asked = touched.select("pairAddress", start.alias("windowStart"), end.alias("windowEnd"), S.window_id(F.col("pairAddress"), start, end).alias("windowId"))
    found = rows.drop("windowId", "windowEnd").withColumn("_here", F.lit(True))
    return null_safe(asked, found, ["pairAddress", "windowStart"], "left").select(*rows.columns, F.col("_here").isNull().alias("gone"))


def start_corrections(statements: DataFrame, plan: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...], minutes: int, base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps statements and windows as tables under base, each batch once; windows() reads what holds."""
    schema = statements.schema

    def each(batch: DataFrame, n: int) -> None:
        said = batch.persist()
        try:
            sinks.commit(said, n, f"{base}/statements", "said")
            kept = sinks.committed(said.sparkSession, f"{base}/statements", schema)
            sinks.commit(corrected(kept, said, plan, kinds, minutes).withColumn("batch", F.lit(n).cast("long")), n, f"{base}/windows", "windows")
        finally:
            said.unpersist()

    return started(statements, statements.writeStream.foreachBatch(each), checkpoint, trigger)


def windows(spark: SparkSession, base: str, statements: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last word on each window, without those that are gone. statements gives the schema only."""
    none = spark.createDataFrame([], statements.drop("removed", "stated").schema)
    schema = plan(none).withColumns({"gone": F.lit(False), "batch": F.lit(0).cast("long")}).schema
    told = sinks.committed(spark, f"{base}/windows", schema)
    last = told.groupBy("windowStart", "pairAddress").agg(F.max_by(F.struct(*told.columns), "batch").alias("_last"))
    return last.select("_last.*").where("not gone").drop("gone", "batch")
