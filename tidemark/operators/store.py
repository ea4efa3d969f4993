"""Result tables: range scans, latest rows, retention, summaries, and pool health.

A result table holds rows of one kind; its score column is windowStart, or detectedAt for alerts. Writers partition it
by pool and day, so that range and pool predicates prune files; here they are plain predicates that reach the scan.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HOUR = 3_600_000
DAY = 24 * HOUR


def in_range(table: DataFrame, pair: str | None, start: int, end: int, score: str = "windowStart") -> DataFrame:
    """Rows with start <= score <= end, both ends included, in ascending order; rows written twice count once."""
    rows = table.where(F.col(score).between(start, end))
    if pair is not None:
        rows = rows.where(F.col("pairAddress") == pair)
    return rows.dropDuplicates().orderBy(score, *(["pairAddress"] if pair is None else []))


def alerts_in_range(table: DataFrame, pair: str | None, start: int, end: int) -> DataFrame:
    """Alerts, the latest first."""
    rows = in_range(table, pair, start, end, "detectedAt")
    return rows.orderBy(F.desc("detectedAt"), F.desc("alertId"))


def latest(table: DataFrame, score: str = "windowStart") -> DataFrame:
    """The latest row of each pool; of equal scores, the one with the greater windowId."""
    names = [c for c in table.columns if c != "pairAddress"]
    picked = table.groupBy("pairAddress").agg(F.max_by(F.struct(*names), F.struct(score, "windowId")).alias("_r"))
    return picked.select("pairAddress", *[F.col(f"_r.{c}").alias(c) for c in names])


def retained(table: DataFrame, now: int, hours: int, score: str = "windowStart") -> DataFrame:
    """What a store keeps: rows younger than the given hours."""
    return table.where(F.col(score) > now - hours * HOUR)


#: Pools and days of one batch that are named in the filter on what is stored; a batch of more pools is looked up by days alone.
MOST_NAMED = 500


def _fs(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(rows: DataFrame, column: str) -> Column | None:
    """A filter for the values that rows have in a column; None if there are too many to name."""
    values = [r[0] for r in rows.select(column).distinct().limit(MOST_NAMED + 1).collect()]
    if len(values) > MOST_NAMED:
        return None
    there = F.col(column).isin([v for v in values if v is not None])
    return there | F.col(column).isNull() if None in values else there


def missing_from(rows: DataFrame, path: str) -> DataFrame:
    """Rows (with their day) that a stored table does not have yet, each once. Of what is stored, only the pools and days of the
    rows are read."""
    spark = rows.sparkSession
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return rows.dropDuplicates()
    there = read_results(spark, path, rows.schema)
    for column in ("day", "pairAddress"):
        named = _named(rows, column)
        if named is not None:
            there = there.where(named)
    return rows.subtract(there)


def _ledger(path: str, writer: str = "", batch: int | None = None) -> str:
    return f"{path.rstrip('/')}/_ledger" + (f"/writer={writer}" if writer else "") + (f"/batch={batch}" if batch is not None else "")


def write_results(table: DataFrame, path: str, score: str = "windowStart", batch: tuple[str, int] | None = None, keep: tuple[int, int] | None = None) -> None:
    """Appends results, partitioned by pool and UTC day of the score. Rows that are there already are not written again, so
    that a batch can be repeated; of rows of one kind that differ, all stay, as in a set of results.

    batch: the writer's name and the number of the batch; its rows are then counted in a ledger, once however often the batch
    is applied, whether or not they were there before. keep: now in milliseconds and hours; days of the pools written that are
    over for longer are deleted. One writer at a time.
    """
    spark = table.sparkSession
    if batch and _fs(spark, f"{_ledger(path, *batch)}/_SUCCESS")[1].exists(_fs(spark, f"{_ledger(path, *batch)}/_SUCCESS")[0]):
        return
    rows = table.withColumn("day", F.date_format(F.timestamp_millis(F.col(score)), "yyyy-MM-dd")).persist()
    try:
        missing_from(rows, path).repartition("pairAddress", "day").write.mode("append").partitionBy("pairAddress", "day").parquet(path)
        if batch:
            rows.groupBy("pairAddress").agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(_ledger(path, *batch))
        if keep:
            pools = [r[0] for r in rows.select("pairAddress").distinct().limit(MOST_NAMED + 1).collect()]
            drop_expired(spark, path, *keep, pools=pools if len(pools) <= MOST_NAMED else None)
    finally:
        rows.unpersist()


def counters(spark: SparkSession, path: str) -> DataFrame:
    """pairAddress and rows: results that batches have brought to a stored table, those that were there already included."""
    where, fs = _fs(spark, _ledger(path))
    schema = "pairAddress string, rows long"
    entries = spark.read.schema(f"{schema}, writer string, batch long").parquet(_ledger(path)) if fs.exists(where) else spark.createDataFrame([], schema)
    return entries.groupBy("pairAddress").agg(F.sum("rows").alias("rows"))


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored result table, with the columns of schema."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def drop_expired(spark: SparkSession, path: str, now: int, hours: int, pools: list[str | None] | None = None) -> int:
    """Deletes the days of a stored table (or of some of its pools) that are over for longer than the given hours; the number
    of folders deleted.

    Rows of the day that the limit falls in go with it; until then `retained` leaves them out.
    """
    last = (dt.datetime.fromtimestamp((now - hours * HOUR) / 1000, dt.UTC)).date().isoformat()
    where, fs = _fs(spark, path)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    wanted = None if pools is None else {f"pairAddress={names.DEFAULT_PARTITION_NAME() if p is None else names.escapePathName(p)}" for p in pools}
    gone = 0
    for pool in fs.listStatus(where):
        if pool.isDirectory() and pool.getPath().getName().startswith("pairAddress=") and (wanted is None or pool.getPath().getName() in wanted):
            for day in fs.listStatus(pool.getPath()):
                if day.getPath().getName().startswith("day=") and day.getPath().getName()[4:] < last:
                    gone += bool(fs.delete(day.getPath(), True))
    return gone


def tracked_pairs(*tables: DataFrame) -> DataFrame:
    """Pools that any of the tables has."""
    return reduce(DataFrame.unionByName, [t.select("pairAddress").distinct() for t in tables]).distinct()


def summary(trading: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Pools and windows of either kind, in one row; windows written twice count twice, as a counter does."""
    a = trading.agg(F.count_distinct("pairAddress").alias("tradingPairsTracked"), F.count("*").alias("totalTradingWindows"))
    b = liquidity.agg(F.count_distinct("pairAddress").alias("liquidityPairsTracked"), F.count("*").alias("totalLiquidityWindows"))
    return a.join(F.broadcast(b))  # one row each


def pair_summaries(trading: DataFrame, now: int) -> DataFrame:
    """Latest symbols, price and volume of each pool, and its windows up to now."""
    picked = F.struct("token0Symbol", "token1Symbol", "twap", "volumeUSD")
    found = trading.groupBy("pairAddress").agg(F.max_by(picked, F.struct("windowStart", "windowId")).alias("r"), F.count_if(F.col("windowStart").between(0, now)).alias("windowCount"))
    return found.select("pairAddress", F.col("r.token0Symbol").alias("token0Symbol"), F.col("r.token1Symbol").alias("token1Symbol"), F.col("r.twap").alias("latestTwap"), F.col("r.volumeUSD").alias("latestVolumeUSD"), "windowCount")


def trading_score(windows: Column, usd: Column, traders: Column) -> Column:
    one = F.lit(1.0)
    return F.least(windows / 24.0, one) * 0.3 + F.least(usd / 100000.0, one) * 0.4 + F.least(traders / 10.0, one) * 0.3


def liquidity_score(windows: Column) -> Column:
    """Neutral without any window, which is more than a few windows give."""
    return F.when(windows == 0, 0.5).otherwise(F.least(windows / 12.0, F.lit(1.0)))


def safety_score(found: Column) -> Column:
    return F.when(found == 0, 1.0).when(found <= 2, 0.7).when(found <= 5, 0.4).otherwise(0.1)


def pool_health(trading: DataFrame, liquidity: DataFrame, found: DataFrame, trends: DataFrame, now: int, pairs: DataFrame | None = None) -> DataFrame:
    """Scores of the last 24 hours for every pool (or those in pairs), with the latest trend of all time. found: alerts, or rows that
    stand for a number of them (column alerts)."""
    day = lambda t, score="windowStart": t.where(F.col(score).between(now - DAY, now))
    t = day(trading).groupBy("pairAddress").agg(F.count("*").alias("_w"), F.coalesce(F.sum("volumeUSD"), F.lit(0.0)).alias("volumeUSD24h"), F.max("uniqueTraders").alias("_u"))
    lq = day(liquidity).groupBy("pairAddress").agg(F.count("*").alias("_l"))
    al = day(found, "detectedAt").groupBy("pairAddress").agg((F.sum("alerts") if "alerts" in found.columns else F.count("*")).alias("_a"))
    tr = trends.groupBy("pairAddress").agg(F.max_by("trend", F.struct("windowStart", "windowId")).alias("_t"))
    base = tracked_pairs(trading, liquidity, found, trends) if pairs is None else pairs.select("pairAddress")
    rows = reduce(lambda a, b: a.join(b, "pairAddress", "left"), [t, lq, al, tr], base)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    usd = F.coalesce("volumeUSD24h", F.lit(0.0))
    scored = rows.select(
        "pairAddress", trading_score(zero("_w"), usd, zero("_u")).alias("tradingScore"), liquidity_score(zero("_l")).alias("liquidityScore"), safety_score(zero("_a")).alias("safetyScore"),
        F.coalesce("_t", F.lit("UNKNOWN")).alias("trend"), zero("_a").cast("int").alias("recentAlertCount"), usd.alias("volumeUSD24h"), zero("_u").cast("int").alias("uniqueTraders24h"),
    )
    overall = F.col("tradingScore") * 0.35 + F.col("liquidityScore") * 0.35 + F.col("safetyScore") * 0.30
    return scored.withColumn("overallScore", F.floor(overall * 100 + 0.5) / 100)


def leaderboard(health: DataFrame) -> DataFrame:
    return health.orderBy(F.desc("overallScore"), "pairAddress")
