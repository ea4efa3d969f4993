"""The same transforms on streams.

Trading and trend windows are incremental aggregates in append mode, first over (window, pool, trader) and then over
(window, pool), so that a hot pool's traders never meet in one task: a window comes out once, when the watermark passes
its end. Events of liquidity windows (a row each) and of sessions (rows of many) are kept until these close, and then go
through the batch plans in foreachBatch, so that a stream and a batch over the same rows agree row by row. Late rows are dropped by the watermark.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import EngineConfig, result_topics
from tidemark.operators import decode, liquidity, sessions, trading
from tidemark.sources.chain import arrival
from tidemark.streaming import sinks
from tidemark.streaming.keyed import closed_sessions, finality_gate, started
from tidemark.streaming.sinks import ERRORS, broker_rows


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def read_broker(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Values of a Kafka topic from its start on; needs Spark's Kafka package on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load().select("value")


def with_lateness(events: DataFrame, seconds: int = 60) -> DataFrame:
    return events.withWatermark("event_time", f"{seconds} seconds")


def without_copies(events: DataFrame) -> DataFrame:
    """Opt-in: one event of each eventId, on streams within the watermark. No plan does this by itself."""
    return events.dropDuplicatesWithinWatermark(["eventId"]) if events.isStreaming else events.dropDuplicates(["eventId"])


def _windows(events: DataFrame, window) -> DataFrame:
    return trading.finish(trading.windows_with_traders(trading.swaps_of(events), window), "uniqueTraders", "repeatedTraders").drop("window")


def trading_stream(events: DataFrame, minutes: int = 5) -> DataFrame:
    return _windows(events, F.window("event_time", f"{minutes} minutes"))


def trend_stream(events: DataFrame, minutes: int = 30, slide: int = 5) -> DataFrame:
    """Panes of the slide first, then windows of panes: a swap is kept in one pane, not in each window that holds it."""
    panes = trading.trader_states(trading.swaps_of(events), F.window("event_time", f"{slide} minutes")).withColumnRenamed("window", "pane")
    inside = panes.withColumn("window", F.window(F.window_time("pane"), f"{minutes} minutes", f"{slide} minutes"))
    by_trader = trading.merge(inside, [*trading.KEYS, "trader"], F.sum("n").alias("n"))
    return trading.trend_rows(trading.finish(trading.with_traders(by_trader), "uniqueTraders", "repeatedTraders").drop("window"))


def closed_groups(events: DataFrame, window) -> DataFrame:
    """One row per pool and window, with all its events, once it is closed."""
    return events.groupBy("pairAddress", window.alias("_w")).agg(F.collect_list(F.struct(*events.columns)).alias("_events"))


def _replayed(batch: DataFrame) -> DataFrame:
    return batch.select(F.explode("_events").alias("e")).select("e.*")


def start_liquidity(events: DataFrame, minutes: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    groups = closed_groups(events.where(F.col("eventType") != "Swap"), F.window("event_time", f"{minutes} minutes"))
    plan = lambda rows: liquidity.liquidity_windows(_replayed(rows), minutes)
    return _start(groups, plan, sink, checkpoint, trigger)


def start_alerts(events: DataFrame, gap: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return _start(closed_sessions(events, gap), lambda rows: sessions.alerts(rows, gap), sink, checkpoint, trigger)


def _start(closed: DataFrame, plan, sink, checkpoint: str, trigger: dict) -> StreamingQuery:
    def each(batch: DataFrame, n: int) -> None:
        rows = batch.persist()  # a plan reads its events several times, the state once
        try:
            sink(plan(rows), n)
        finally:
            rows.unpersist()

    return started(closed, closed.writeStream.foreachBatch(each), checkpoint, trigger)


def start_append(results: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", few: bool = False, **trigger) -> StreamingQuery:
    """Exactly once: the file sink commits each batch by its number, and windowId names each row. few: as in started()."""
    return started(results, results.writeStream.outputMode("append").format(fmt).option("path", path), checkpoint, trigger, few=few)


def start_fan_out(results: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch to several sinks, computed once."""

    def each(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, n)
        finally:
            held.unpersist()

    return started(results, results.writeStream.foreachBatch(each), checkpoint, trigger)


def start_broker(results: DataFrame, servers: str, topic: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Result rows as JSON to a Kafka topic, keyed by pool; needs Spark's Kafka package. A batch that is sent again after a
    failure bears the same windowId, by which readers drop it."""
    return broker_rows(results).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).trigger(**trigger).start()


Sink = Callable[[DataFrame, int, str], None]  # rows of a batch, its number, and the topic that they go to


def start_bronze(raw: DataFrame, stream: str, base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Decodes the messages of a stream (column value), once each, into tables of events and of errors under base/stream, from
    which any number of streams can read."""
    def each(batch: DataFrame, n: int) -> None:
        rows = decode.decoded(batch, stream).persist()
        try:
            events, bad = decode.split(rows)
            sinks.commit(events.withColumn("seq", arrival(F.col("blockNumber"), F.col("logIndex"))), n, f"{base}/{stream}/events", "bronze")
            sinks.commit(decode.error_rows(bad, stream, int(time.time() * 1000)), n, f"{base}/{stream}/errors", "bronze")
        finally:
            rows.unpersist()

    return started(raw, raw.writeStream.foreachBatch(each), checkpoint, trigger)


def bronze_events(spark: SparkSession, base: str, stream: str, files_per_trigger: int | None = None) -> DataFrame:
    """Decoded events of a stream, as a stream."""
    events, _ = decode.events_from(spark.createDataFrame([], "value string"), stream)
    schema = events.withColumn("seq", F.lit(0).cast("long")).schema
    return sinks.committed_stream(spark, f"{base}/{stream}/events", schema, files_per_trigger)


def bronze_errors(spark: SparkSession, base: str, stream: str) -> DataFrame:
    schema = decode.error_rows(spark.createDataFrame([], "value string, error string"), stream, 0).schema
    return sinks.committed_stream(spark, f"{base}/{stream}/errors", schema)


def start_engine(trading_raw: DataFrame, liquidity_raw: DataFrame, config: EngineConfig, sink: Sink, base: str, **trigger) -> list[StreamingQuery]:
    """The whole job: two streams of envelopes (column value) are decoded into tables, and four kinds of results and the errors are
    made of these.

    An envelope is read and decoded once, whatever number of results is made of it. With a trigger that ends, decoding ends
    first. Tables and checkpoints are kept under base.
    """
    spark = trading_raw.sparkSession
    bronze, at = f"{base}/bronze", lambda name: f"{base}/checkpoints/{name}"
    begun = [start_bronze(raw, name, bronze, at(f"bronze-{name}"), **trigger) for name, raw in (("trading", trading_raw), ("liquidity", liquidity_raw))]
    if trigger.get("availableNow") or trigger.get("once"):
        for query in begun:
            query.awaitTermination()
    swaps, moves = (with_lateness(bronze_events(spark, bronze, name), config.lateness_seconds) for name in ("trading", "liquidity"))

    def to(topic: str, rows: DataFrame) -> None:
        begun.append(started(rows, rows.writeStream.outputMode("append").foreachBatch(lambda batch, n: sink(batch, n, topic)), at(topic), trigger))

    explicit = len(config.trading_minutes) > 1
    for minutes, topic in result_topics(config.trading_minutes, "trading-analytics", explicit).items():
        to(topic, trading_stream(swaps, minutes))
    explicit = len(config.liquidity_minutes) > 1
    for minutes, topic in result_topics(config.liquidity_minutes, "liquidity-analytics", explicit).items():
        begun.append(start_liquidity(moves, minutes, lambda rows, n, topic=topic: sink(rows, n, topic), at(topic), **trigger))
    both = swaps.unionByName(moves, allowMissingColumns=True)
    begun.append(start_alerts(both, config.session_gap_seconds, lambda rows, n: sink(rows, n, "pattern-analytics"), at("pattern-analytics"), **trigger))
    to("market-trends", trend_stream(swaps, config.trend_minutes, config.trend_slide_minutes))
    to(ERRORS, bronze_errors(spark, bronze, "trading").unionByName(bronze_errors(spark, bronze, "liquidity")))
    return begun


def start_publish(events: DataFrame, config: EngineConfig, sink: Sink, checkpoint: str, **trigger) -> StreamingQuery:
    """Events that are final (config.finality_blocks) as envelopes to the topic of their kind; those that cannot be encoded go to
    the errors."""

    def each(batch: DataFrame, n: int) -> None:
        rows = decode.encoded(batch).persist()
        try:
            sent = decode.envelopes(rows)
            for topic in (decode.TRADING_TOPIC, decode.LIQUIDITY_TOPIC):
                sink(sent.where(F.col("topic") == topic).drop("topic"), n, topic)
            sink(rows.where("body is null").select("eventId", "eventType", F.col("encodeError").alias("error")), n, ERRORS)
        finally:
            rows.unpersist()

    final = finality_gate(events, config.finality_blocks)
    return started(final, final.writeStream.outputMode("append").foreachBatch(each), checkpoint, trigger)
