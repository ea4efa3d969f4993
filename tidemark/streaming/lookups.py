"""Contract logs, blocks and receipts as streams: a log waits for its block and its receipt, and goes on without those that
do not come.

Each stream has its own time of arrival and watermark. A log is joined with what arrives within `wait` seconds before or
after it; that bound lets Spark drop what it holds of all three sides. Known facts of slow change (pools, symbols, rounds of
prices) are looked up batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.config import EngineConfig
from tidemark.sources import chain
from tidemark.sources.log_files import LOGS
from tidemark.streaming import jobs, sinks
from tidemark.streaming.keyed import started

#: What a log that no block came for is called in its error row.
NO_BLOCK = "unknown block"
#: Pools sent whole to every executor, at most. Streams do not split the many logs of one pool, as a join by shuffle would need.
BROADCAST_POOLS = 100_000


def located(logs: DataFrame, blocks: DataFrame, receipts: DataFrame, wait: int = 600, lateness: int = 60) -> DataFrame:
    """Parsed logs with blockTimestamp, gasUsed and effectiveGasPrice, each null where no block or receipt came in time.

    All three streams have seenAt, the time they were seen. A matched log goes out at once, another when the watermark (of the
    slowest stream) is `wait` past it. Two left outer joins, one after the other; logs wait as they came, and are parsed when
    they go out. Those that are no events wait like the rest.
    """
    late = lambda df, name: df.withColumnRenamed("seenAt", name).withWatermark(name, f"{lateness} seconds")
    span = F.expr(f"INTERVAL {wait} SECONDS")
    near = lambda name: F.col(name).between(F.col("seenAt") - span, F.col("seenAt") + span)
    gas = late(receipts.select(F.col("transactionHash").alias("_tx"), "gasUsed", "effectiveGasPrice", "seenAt"), "_gasAt")
    times = late(blocks.select(F.col("blockNumber").alias("_block"), "blockTimestamp", "seenAt"), "_blockAt")
    rows = late(logs, "seenAt").join(gas, (F.col("transactionHash") == F.col("_tx")) & near("_gasAt"), "left")
    rows = rows.join(times, (F.col("blockNumber") == F.col("_block")) & near("_blockAt"), "left")
    return chain.parse_logs(rows.drop("_tx", "_gasAt", "_block", "_blockAt"))


def few(pools: DataFrame) -> DataFrame:
    """Pools, marked to be sent to every executor if they are few."""
    return F.broadcast(pools) if pools.limit(BROADCAST_POOLS + 1).count() <= BROADCAST_POOLS else pools


def start_events(logs: DataFrame, blocks: DataFrame, receipts: DataFrame, tokens: DataFrame, pairs: DataFrame, rounds: DataFrame, stablecoins: list[str], sink: Callable[[DataFrame, int], None], lost: Callable[[DataFrame, int], None], checkpoint: str, wait: int = 600, lateness: int = 60, **trigger) -> StreamingQuery:
    """Events of streams of logs, blocks and receipts to sink, as chain.enrich makes them of tables; logs that are no events,
    or of blocks that never came, to lost, with error. tokens, pairs and rounds are read anew for each batch."""

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.persist()
        try:
            good = F.col("error").isNull() & F.col("blockTimestamp").isNotNull()
            sink(chain.described(rows.where(good), few(chain.named_pools(tokens, pairs)), rounds, stablecoins), n)
            lost(rows.where(~good).withColumn("error", F.coalesce("error", F.lit(NO_BLOCK))).drop("blockTimestamp", "gasUsed", "effectiveGasPrice"), n)
        finally:
            rows.unpersist()

    rows = located(logs, blocks, receipts, wait, lateness)
    return started(rows, rows.writeStream.outputMode("append").foreachBatch(each), checkpoint, trigger, joins=True)


def event_schema(spark: SparkSession) -> StructType:
    """The columns of events that chain.described makes."""
    none = lambda schema: spark.createDataFrame([], schema)
    located_logs = chain.parse_logs(none(LOGS)).selectExpr("*", "0L AS blockTimestamp", "0L AS gasUsed", "'' AS effectiveGasPrice")
    pools, rounds = none("pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int"), none("token string, updatedAt long, answer string, decimals int")
    return chain.described(located_logs, chain.named_pools(none("token string, symbol string"), pools), rounds, []).schema


#: The topic of logs that are no events, or of blocks that never came.
LOST = "ingest-errors"


def start_ingest(logs: DataFrame, blocks: DataFrame, receipts: DataFrame, tokens: DataFrame, pairs: DataFrame, rounds: DataFrame, config: EngineConfig, sink: jobs.Sink, base: str, stablecoins: list[str] = chain.STABLECOINS, wait: int = 600, **trigger) -> list[StreamingQuery]:
    """From logs to messages: logs of known pools are parsed and looked up, events kept under base until they are final
    (config.finality_blocks), and then sent in envelopes to the topics of their kinds. Errors have topics of their own."""
    spark, kept = logs.sparkSession, f"{base}/events"
    refused = ["blockNumber", "transactionHash", "logIndex", "address", "eventType", "error"]
    first = start_events(
        chain.of_pools(logs, pairs), blocks, receipts, tokens, pairs, rounds, stablecoins,
        lambda rows, n: sinks.commit(rows, n, kept, "events"), lambda rows, n: sink(rows.select(*refused), n, LOST), f"{base}/checkpoints/events", wait, config.lateness_seconds, **trigger)
    if trigger.get("availableNow") or trigger.get("once"):
        first.awaitTermination()
    return [first, jobs.start_publish(sinks.committed_stream(spark, kept, event_schema(spark)), config, sink, f"{base}/checkpoints/publish", **trigger)]
