"""What a join of streams costs whatever it holds, and that the logs of one pool do not go through one task."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import boundary
from tidemark.sources import chain
from tidemark.streaming import keyed, lookups


@pytest.fixture
def wide(spark):
    """A session with as many shuffle partitions as Spark has by default."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_joins_of_streams_keep_few_databases_and_send_few_pools(wide, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "JOIN_PARTS", 8)
    most = max(8, 4 * wide.sparkContext.defaultParallelism)
    at = F.timestamp_seconds(F.lit(1_700_000_000)).alias("seenAt")
    topics = F.array(F.lit(chain.SIGNATURES["Mint"]), F.lit("0x" + "1" * 64))
    logs = wide.range(4).select(F.lit(5).cast("long").alias("blockNumber"), F.concat(F.lit("tx-"), "id").alias("transactionHash"), F.col("id").alias("logIndex"), F.lit("P").alias("address"), topics.alias("topics"), F.lit("0x" + "0" * 128).alias("data"), at)
    blocks = wide.range(1).select(F.lit(5).cast("long").alias("blockNumber"), F.lit(1_700_000_000).cast("long").alias("blockTimestamp"), at)
    receipts = wide.range(4).select(F.concat(F.lit("tx-"), "id").alias("transactionHash"), F.lit(1).cast("long").alias("gasUsed"), F.lit("2").alias("effectiveGasPrice"), at)
    streams = []
    for k, rows in enumerate((logs, blocks, receipts)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        streams.append(wide.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{k}"))
    tokens, pools = wide.createDataFrame([("a", "AAA")], "token string, symbol string"), wide.createDataFrame([("p", "a", "b", 0, 0)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")
    rounds = wide.createDataFrame([], "token string, updatedAt long, answer string, decimals int")
    plans, got, lost = [], [], []

    def sink(rows, n):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        got.extend(rows.select("logIndex", "token0Symbol", "token1Symbol").collect())

    lookups.start_events(*streams, tokens, pools, rounds, ["b"], sink, lambda rows, n: lost.extend(rows.collect()), f"{tmp_path}/c", availableNow=True).awaitTermination()
    assert sorted(map(tuple, got)) == [(k, "AAA", None) for k in range(4)] and lost == []
    for join in ("0", "1"):
        parts = [p for p in glob.glob(f"{tmp_path}/c/state/{join}/*") if os.path.basename(p).isdigit()]
        assert len(parts) == most
        assert not [store for p in parts for store in glob.glob(f"{p}/*keyTo*")]  # one database for each part, not four
    assert plans and all("BroadcastHashJoin" in p and "hashpartitioning(pairAddress" not in p for p in plans)
    assert wide.conf.get("spark.sql.shuffle.partitions") == "200"


def test_prices_reach_logs_of_pools_without_a_token(spark):
    """A pool with an unknown token, and two pools of the same tokens, keep their logs once each."""
    pools = spark.createDataFrame([("p", "a", None, 0, 0), ("q", "a", "b", 0, 0), ("r", "a", "b", 0, 0)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")
    tokens = spark.createDataFrame([("a", "AAA")], "token string, symbol string")
    rounds = spark.createDataFrame([("a", 1_699_999_000, "5", 0)], "token string, updatedAt long, answer string, decimals int")
    word = "0" * 63
    rows = [(5, f"tx-{k}", k, pool, [chain.SIGNATURES["Swap"], "0x" + "1" * 64, "0x" + "2" * 64], f"0x{word}2{word}0{word}0{word}3") for k, pool in enumerate("ppqr")]
    logs = spark.createDataFrame(rows, "blockNumber long, transactionHash string, logIndex long, address string, topics array<string>, data string")
    blocks, receipts = spark.createDataFrame([(5, 1_700_000_000)], "blockNumber long, blockTimestamp long"), spark.createDataFrame([], "transactionHash string, gasUsed long, effectiveGasPrice string")
    events = chain.enrich(chain.parse_logs(logs), blocks, receipts, tokens, pools, rounds, [])
    got = sorted((r["logIndex"], r["pairAddress"], r["token0Symbol"], r["volumeUSD"]) for r in events.collect())
    assert got == [(0, "p", "AAA", 10.0), (1, "p", "AAA", 10.0), (2, "q", "AAA", 10.0), (3, "r", "AAA", 10.0)]
    assert set(boundary.ENRICHED) <= set(events.columns)
