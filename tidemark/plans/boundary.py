"""Queries over the engine's edges: numbers and symbols, contract logs, Avro bodies, JSON results, stored tables and streams."""

from __future__ import annotations

import time
from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.config import EngineConfig
from tidemark.functions import bigint
from tidemark.functions import scalars as S
from tidemark.operators import decode, liquidity, sessions, store, trading
from tidemark.plans import api
from tidemark.plans.queries import EV, FROM, GAP, JIT, LIQUIDITY, NOW, SANDWICH, SESSIONS, TRENDS, TW, _windows, prices_table
from tidemark.sources import chain, log_files
from tidemark.sources.testdata import as_exchange_events, exchange_events
from tidemark.storage import new_folder
from tidemark.streaming import corrections, jobs, keyed, lookups, sinks

DIGITS, ARABIC = "0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"
AMOUNTS = ["amount0In", "amount1In", "amount0Out", "amount1Out"]


def pick(n: Column, *values: Column) -> Column:
    """The value at n modulo their number."""
    return F.element_at(F.array(*values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def parse_amounts(events: DataFrame) -> DataFrame:
    """Amounts as people and programs write them, and symbols with blanks."""
    n, x = F.col("seq"), F.coalesce("amount0", "value", "amount0In")
    text = pick(n, x, F.concat(F.lit("\t "), x, F.lit("\n")), F.concat(F.lit("-"), x), F.lit("1.5"), F.lit(""), F.lit(None).cast("string"), F.concat(x, F.lit("\n")), F.concat(F.lit("+"), x), F.translate(x, DIGITS, ARABIC), F.concat(F.lit("-"), F.repeat(x, F.lit(15))))
    symbol = S.prefer_symbol(pick(n, F.lit(None).cast("string"), F.lit(" \t"), F.lit("AA")), pick(n, F.lit("BB"), F.lit("CC"), F.lit("BB")))
    # Columns of their own, so that each text is made and parsed once, not once for each use of it.
    rows = events.select("seq", text.alias("text"), symbol.alias("symbol")).withColumn("number", bigint.padded(F.col("text"))).withColumn("limbs", bigint.parsed("number"))
    return rows.select("seq", bigint.to_text("limbs").alias("amount"), bigint.sign_of("number").alias("sign"), "symbol")


def long_sums(events: DataFrame) -> DataFrame:
    """Sums of liquidity whose amounts have 200 digits more, exactly."""
    moves = events.where(F.col("eventType").isin("Mint", "Burn")).withColumn("amount0", F.concat(F.col("amount0"), F.repeat(F.lit("0"), F.lit(200))))
    rows = liquidity.liquidity_windows(moves)
    return rows.select("windowId", "totalMintAmount0", "totalBurnAmount0", "netLiquidityChange0")


def usd_volume_rules(events: DataFrame) -> DataFrame:
    """USD volume of swaps by each of its five rules in turn."""
    n, none = F.col("seq"), F.lit(None).cast("double")
    usd0, usd1 = pick(n, none, F.lit(1.0), F.lit(3.0), none, none), pick(n, F.lit(1.0), F.lit(2.0), none, F.lit(2.0), none)
    amounts = [F.col(c) for c in AMOUNTS]
    price = S.price_from_amounts(*amounts, F.lit(18), F.lit(16))
    usd = S.usd_volume(*amounts, F.lit(18), F.lit(16), usd0, usd1, price)
    return trading.swaps_of(events).select("seq", F.round(usd, 6).alias("usd"))


def event_times(events: DataFrame) -> DataFrame:
    return events.select("seq", S.rfc3339(F.col("blockTimestamp")).alias("time"), S.cloud_event_type(F.col("eventType")).alias("type"), S.event_id(F.col("transactionHash"), F.col("logIndex")).alias("id"))


def alert_descriptions(events: DataFrame) -> DataFrame:
    return sessions.descriptions(events, GAP)


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract logs made from the events table, some of them broken in a known way."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "Swap").when(F.col("event_type") == "signup", "Mint").when(F.col("event_type") == "error", "Burn").when(F.col("event_type") == "view", "Transfer")
    n, cents, user = F.col("event_id"), F.round(F.col("value") * 100).cast("long"), F.col("user_id")
    word = lambda x: F.lpad(F.lower(F.hex(x)), 64, "0")
    first = F.element_at(F.create_map(*[F.lit(v) for kv in chain.SIGNATURES.items() for v in kv]), kind)
    first = F.when(F.pmod(n, F.lit(13)) == 7, "0x00").otherwise(first)
    topics = F.when(kind == "Mint", F.array(first, F.concat(F.lit("0x"), word(F.pmod(user, F.lit(4)))))).otherwise(F.array(first, F.concat(F.lit("0x"), word(F.pmod(user, F.lit(4)))), F.concat(F.lit("0x"), word(F.pmod(F.floor(user / 4).cast("long"), F.lit(4)) + 1))))
    topics = F.when(F.pmod(n, F.lit(13)) == 6, F.array(first)).otherwise(topics)
    words = F.when(kind == "Swap", F.concat(word(cents + 1), word(F.lit(0)), word(F.lit(0)), word(cents + 2))).when(kind == "Transfer", word(cents + 5)).otherwise(F.concat(word(cents + 3), F.repeat(F.lit("f"), F.lit(64))))
    data = F.when((F.pmod(n, F.lit(13)) == 9) & (kind == "Transfer"), "0x").when(F.pmod(n, F.lit(13)) == 5, "0x12").when(F.pmod(n, F.lit(13)) == 8, F.concat(F.lit("0xzz"), F.substring(words, 3, 300))).otherwise(F.concat(F.lit("0x"), words))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return raw.where(kind.isNotNull()).select(
        F.floor(seconds / 3600).cast("long").alias("blockNumber"), F.concat(F.lit("tx-"), F.floor(n / 2).cast("string")).alias("transactionHash"), n.alias("logIndex"),
        F.concat(F.lit("pool-"), F.pmod(F.floor(n / 2).cast("long"), F.lit(3)).cast("string")).alias("address"), topics.alias("topics"), data.alias("data"),
    )


def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sender", "recipient", "from", "to", *AMOUNTS, "amount0", "amount1", "value"]
    return chain.parse_logs(raw_logs(spark, sf_dir)).select(F.col("logIndex").alias("seq"), "eventType", "error", *columns)


def _pools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"pool-{k}", f"a{k}", f"b{k}", 2, 0) for k in range(3)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")


def subscribed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of two pools from the last 100 blocks on."""
    return chain.subscribed(raw_logs(spark, sf_dir), _pools(spark).where("pairAddress <> 'pool-2'"), 100).select(F.col("logIndex").alias("seq"), "blockNumber", "address")


def _facts(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, receipts, tokens and price rounds of logs: pool-0 has a price of token0 once a day, pool-1 a stablecoin as token1,
    pool-2 no price at all."""
    spark = logs.sparkSession
    blocks = logs.select("blockNumber").distinct().withColumn("blockTimestamp", F.col("blockNumber") * 3600 + 7)
    receipts = logs.groupBy("transactionHash").agg(F.max("blockNumber").alias("_b")).where(F.pmod(_number(), F.lit(3)) != 1).select("transactionHash", (_number() + 21000).alias("gasUsed"), F.when(F.pmod(_number(), F.lit(3)) == 0, _number().cast("string")).alias("effectiveGasPrice"), "_b")
    tokens = spark.createDataFrame([("a0", "AAA"), ("a1", ""), ("a2", "x" * 20), ("b0", "x" * 21), ("b1", "\u00e9" * 10), ("b2", "\u00e9" * 11)], "token string, symbol string")
    days = blocks.select(F.floor(F.col("blockNumber") / 24).alias("day")).distinct()
    rounds = days.select(F.lit("a0").alias("token"), (F.col("day") * 86400).alias("updatedAt"), (F.col("day") * 100000000 + 50000000).cast("string").alias("answer"), F.lit(8).alias("decimals"))
    return blocks, receipts, tokens, rounds


def _number() -> Column:
    return F.substring_index("transactionHash", "-", -1).cast("long")


ENRICHED = ["eventId", "eventType", "blockTimestamp", "pairAddress", "token0Symbol", "token1Symbol", "price", "volumeUSD", "gasUsed", "gasPrice"]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"price": F.round("price", 8), "volumeUSD": F.round("volumeUSD", 6)}).select(*ENRICHED)


def enriched_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of logs, with what other tables know of them."""
    logs = raw_logs(spark, sf_dir)
    blocks, receipts, tokens, rounds = _facts(logs)
    return _rounded(chain.enrich(chain.parse_logs(logs), blocks, receipts.drop("_b"), tokens, _pools(spark), rounds, ["b1"]))


def in_files(rows: DataFrame, order: str, triggers: int) -> DataFrame:
    """Rows as a stream of so many triggers in the given order. What comes in one trigger lies in a file for each core, so that no
    task writes or reads a trigger alone."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "arriving")
    files = max(spark.sparkContext.defaultParallelism, 1)
    rows.repartitionByRange(triggers * files, order).write.parquet(path)
    _set_times(spark, path)
    return jobs.read_files(spark, path, rows.schema, files_per_trigger=files)


def _set_times(spark: SparkSession, path: str) -> None:
    """Gives the files of a folder times in the order of their names, as a file source goes by these."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath().getName(), f) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    begun = int(time.time() * 1000) - 1000 * len(parts)
    for k, (_, f) in enumerate(parts):
        fs.setTimes(f.getPath(), begun + 1000 * k, -1)


#: Seconds that a log waits for its block and its receipt, and a moment at which all streams have gone far on.
WAIT, LATER = 7200, 30 * 86_400


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events of logs, blocks and receipts that arrive as streams over several triggers. Some blocks and receipts
    come too late, or never: such logs are refused, or go on with no gas."""
    logs = raw_logs(spark, sf_dir)
    blocks, receipts, tokens, rounds = _facts(logs)
    at = lambda seconds: F.timestamp_seconds(seconds).alias("seenAt")
    hour = lambda c: F.col(c) * 3600
    heard = logs.select("*", at(hour("blockNumber") + 1800 + F.pmod("logIndex", F.lit(600))))
    mined = blocks.where(F.pmod("blockNumber", F.lit(17)) != 3).select("*", at(hour("blockNumber") + 2400 + F.when(F.pmod("blockNumber", F.lit(11)) == 5, 40_000).otherwise(F.pmod("blockNumber", F.lit(5)) * 300)))
    paid = receipts.select("transactionHash", "gasUsed", "effectiveGasPrice", at(hour("_b") + 2000 + F.when(F.pmod(_number(), F.lit(7)) == 3, 40_000).otherwise(0)))
    # The streams go on: a last log that still waits, and a last block and receipt of others.
    end = F.timestamp_seconds(F.max(F.unix_seconds("seenAt")) + LATER)
    last = lambda rows, **known: rows.unionByName(rows.agg(end.alias("seenAt")).select("seenAt", *[v.alias(k) for k, v in known.items()]), allowMissingColumns=True)
    address = F.lit("0x" + "1" * 64)
    heard = last(heard, blockNumber=F.lit(10**9), transactionHash=F.lit("tx-none"), logIndex=F.lit(0).cast("long"), address=F.lit("pool-0"), topics=F.array(F.lit(chain.SIGNATURES["Mint"]), address), data=F.lit("0x" + "0" * 128))
    mined, paid = last(mined, blockNumber=F.lit(10**9 + 1)), last(paid, transactionHash=F.lit("tx-other"))
    out = new_folder(spark, "stream")
    query = lookups.start_events(
        *[in_files(rows, "seenAt", 4) for rows in (heard, mined, paid)], tokens, _pools(spark), materialized(rounds), ["b1"],
        lambda rows, n: sinks.commit(_rounded(rows).withColumn("refused", F.lit(None).cast("string")), n, out, "events"),
        lambda rows, n: sinks.commit(rows.select(S.event_id(F.col("transactionHash"), F.col("logIndex")).alias("eventId"), F.col("error").alias("refused")), n, out, "lost"),
        new_folder(spark, "checkpoint"), WAIT, 3600, availableNow=True)
    _finish(query)
    schema = _rounded(spark.createDataFrame([], lookups.event_schema(spark))).withColumn("refused", F.lit("")).schema
    return sinks.committed(spark, out, schema)


def materialized(rows: DataFrame) -> DataFrame:
    """Rows kept as a table, which many batches read."""
    path = new_folder(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rounds come up to a day late, and are waited for for two.
OUT_OF_ORDER = 86_400


def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of tokens at the noons of orders, while rounds and questions arrive out of order over several triggers."""
    rounds = prices_table(spark, sf_dir).select("token", "updatedAt", "answer", "decimals")
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("token-"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("token"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 43200).alias("at")).distinct()
    jitter = lambda at, *more: (F.col(at) + F.pmod(F.hash(at, *more), F.lit(OUT_OF_ORDER))).alias("_arrival")
    streams = [in_files(rows, "_arrival", 6).drop("_arrival") for rows in (asked.select("*", jitter("at", "token")), rounds.select("*", jitter("updatedAt", "token", "answer")))]
    found, out = keyed.price_stream(*streams, lateness=2 * OUT_OF_ORDER), new_folder(spark, "stream")
    _finish(jobs.start_append(found, out, new_folder(spark, "checkpoint"), availableNow=True))
    return spark.read.schema(found.schema).parquet(out).withColumn("usd", F.round("usd", 8))


def finality_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate still holds of each pool after all events have come over several triggers, read from the checkpoint."""
    events, at = in_files(exchange_events(spark, sf_dir), "seq", 5), new_folder(spark, "checkpoint")
    _finish(jobs.start_append(jobs.finality_gate(events, 64), new_folder(spark, "stream"), at, few=True, availableNow=True))
    return keyed.pending(spark, at)


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that batches bring to a store, and that it keeps: some batches bring what is there, and one is applied twice."""
    rows, path = materialized(trading.trading_windows(exchange_events(spark, sf_dir))), new_folder(spark, "store")
    early = F.col("windowStart") < FROM
    for n, part in ((0, rows.where(early)), (1, rows), (1, rows), (2, rows.where(~early))):
        store.write_results(part, path, batch=("windows", n))
    kept = store.read_results(spark, path, rows.schema).groupBy("pairAddress").agg(F.count("*").alias("stored"))
    return store.counters(spark, path).join(kept, "pairAddress")


def stream_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading windows as messages of a topic. The job dies between writing its first batch and publishing it, and is started again."""
    windows, out, at = jobs.trading_stream(_stream(spark, sf_dir)), new_folder(spark, "topic"), new_folder(spark, "checkpoint")
    messages = sinks.broker_rows(windows)

    def dies(batch: DataFrame, n: int) -> None:
        sinks.stage(batch, n, out, "stream")
        raise RuntimeError("the job died")

    first = keyed.started(messages, messages.writeStream.foreachBatch(dies), at, {"availableNow": True})
    with suppress(StreamingQueryException):
        first.awaitTermination()
    _finish(sinks.start_committed(messages, out, at, availableNow=True))
    sinks.sweep(spark, out)
    said = lambda name: F.get_json_object("value", f"$.{name}")
    return sinks.committed(spark, out, messages.schema).select("key", said("windowId").alias("windowId"), said("twap").cast("double").alias("twap"), said("swapCount").cast("int").alias("swapCount"))


def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from stored files by the source that counts blocks: from 100 blocks before the latest on, then, after a restart, those
    that have come since."""
    log_files.register(spark)
    logs, path, at, out = raw_logs(spark, sf_dir), new_folder(spark, "logs"), new_folder(spark, "checkpoint"), new_folder(spark, "stream")
    first, last = logs.agg(F.min("blockNumber"), F.max("blockNumber")).first()
    cut = F.lit((first or 0) + ((last or 0) - (first or 0)) * 2 // 3)
    for part in (F.col("blockNumber") < cut, F.col("blockNumber") >= cut):
        logs.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.format(log_files.NAME).options(path=path, backfill=100, addresses="pool-0,pool-1").load()
        rows = stream.where(chain.event_type(F.col("topics")).isNotNull()).select(F.col("logIndex").alias("seq"), "blockNumber", "address")
        _finish(jobs.start_append(rows, out, at, availableNow=True))
    return spark.read.schema("seq long, blockNumber long, address string").parquet(out)


def dealt(rows: DataFrame, by: str, path: str, files: int) -> None:
    """Writes rows to a folder in just so many files, so that a trigger of that many files takes the folder and no more; files that
    no row falls to are empty."""
    spark = rows.sparkSession
    rows.repartition(files, by).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    written = sum(f.getPath().getName().startswith("part-") for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    for _ in range(files - written):
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)


#: Every fiftieth event comes late, by a seventh of all events; all come in six parts.
LATE, PARTS = 50, 6


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading windows of events of which some come days late. The job ends after half of the parts, and goes on with the
    others from its checkpoint; rows of windows that are over by then are left out."""
    events = exchange_events(spark, sf_dir)
    (most,) = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()
    size = (most or 0) + 1
    arrival = F.col("seq") + F.when(F.pmod("seq", F.lit(LATE)) == 0, size // 7).otherwise(0)
    part = F.floor(arrival * PARTS / (size + size // 7)).cast("int")
    path, at, out = new_folder(spark, "arriving"), new_folder(spark, "checkpoint"), new_folder(spark, "stream")
    files, windows = max(spark.sparkContext.defaultParallelism, 1), None
    for half in (range(PARTS // 2), range(PARTS // 2, PARTS)):
        for k in half:
            dealt(events.where(part == k), "seq", f"{path}/{k}", files)
        windows = jobs.trading_stream(jobs.with_lateness(jobs.read_files(spark, f"{path}/*", events.schema, files_per_trigger=files)))
        _finish(jobs.start_append(windows, out, at, availableNow=True))
    return spark.read.schema(windows.schema).parquet(out)


def stream_retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading windows while every tenth event is taken back later, and every thirtieth found again after that."""
    events = exchange_events(spark, sf_dir)
    (most,) = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()
    later = ((most or 0) + 1) // 5
    said = lambda rows, removed, after: rows.select("*", F.lit(removed).alias("removed"), (F.col("seq") + after).alias("stated"))
    every = lambda k: events.where(F.pmod("seq", F.lit(k)) == 0)
    stream = in_files(said(events, False, 0).unionByName(said(every(10), True, later)).unionByName(said(every(30), False, 2 * later)), "stated", 4)
    base = new_folder(spark, "stream")
    _finish(corrections.start_corrections(stream, trading.trading_windows, corrections.SWAPS, 5, base, new_folder(spark, "checkpoint"), availableNow=True))
    return corrections.windows(spark, base, stream, trading.trading_windows)


def avro_liquidity(events: DataFrame) -> DataFrame:
    """Mints, burns and transfers through Avro and an envelope and back."""
    wire = None
    for kind in ("Mint", "Burn", "Transfer"):
        sent = decode.envelopes(decode.encode_bodies(events, kind))
        wire = sent if wire is None else wire.unionByName(sent)
    good, _ = decode.events_from(wire.select("value"), "liquidity")
    return good.drop("event_time")


def json_records(events: DataFrame) -> DataFrame:
    return decode.to_json_records(api.flows(liquidity.liquidity_windows(events)))


def result_rows(events: DataFrame) -> DataFrame:
    """Trading results through the envelopes of a subscription and back; every fifth is broken."""
    rows = trading.trading_windows(events)
    sent = rows.select(F.concat(F.lit('{"data":'), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), F.lit(', "more": 1}')).alias("value"))
    broken = F.when(F.pmod(F.get_json_object("value", "$.data.windowStart").cast("long"), F.lit(1_500_000)) == 0, F.lit("{}")).otherwise(F.col("value"))
    good, bad = decode.results_from(sent.select(broken.alias("value")), "trading-analytics")
    kept = good.select("windowId", "pairAddress", "twap", "volumeUSD", "totalVolume0", "swapCount", "repeatedTraders", F.lit(None).cast("string").alias("refused"))
    return kept.unionByName(bad.groupBy(F.col("error").alias("refused")).agg(F.count("*").cast("int").alias("swapCount")), allowMissingColumns=True)


def empty_record(events: DataFrame) -> DataFrame:
    """The records of hours in which a pool has no swaps, from its first hour with any to its last."""
    return trading.empty_windows(trading.trading_windows(events, 60), 60)


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading windows as a store has them that got half of them twice."""
    rows = trading.trading_windows(exchange_events(spark, sf_dir))
    path = new_folder(spark, "store")
    store.write_results(rows.where(F.col("windowStart") < FROM), path)
    store.write_results(rows, path)
    back = store.read_results(spark, path, rows.schema)
    return store.in_range(back, None, 0, NOW)


def expired_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a store after the days before the last week have been deleted."""
    rows = trading.trading_windows(exchange_events(spark, sf_dir)).select("windowId", "windowStart", "pairAddress", "twap")
    path = new_folder(spark, "store")
    store.write_results(rows, path)
    store.drop_expired(spark, path, NOW, 168)
    return store.read_results(spark, path, rows.schema)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream takes no single file by its name.
    return jobs.with_lateness(as_exchange_events(jobs.read_files(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet").schema)))


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _appended(plan, few: bool = False):
    """A stream that is run over all that is there, and the file sink that it wrote."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results, out = plan(_stream(spark, sf_dir)), new_folder(spark, "stream")
        _finish(jobs.start_append(results, out, new_folder(spark, "checkpoint"), few=few, availableNow=True))
        return spark.read.schema(results.schema).parquet(out)

    return run


def _sunk(start, batch_schema):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = new_folder(spark, "stream")
        _finish(start(_stream(spark, sf_dir), lambda rows, n: rows.write.mode("append").parquet(out), new_folder(spark, "checkpoint")))
        return spark.read.schema(batch_schema(exchange_events(spark, sf_dir)).schema).parquet(out)

    return run


def stream_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over envelopes of all events, some of them broken: what reaches each topic."""
    events = exchange_events(spark, sf_dir)
    made = {k: decode.envelopes(decode.encode_bodies(events, k)).select("value") for k in schemas.EVENTS}
    broken = spark.createDataFrame([("no envelope",), ('{"specversion":"1.0","type":"com.dex.events.other","data":"x"}',)], "value string")
    paths = {}
    for stream, kinds in (("trading", ["Swap"]), ("liquidity", ["Mint", "Burn", "Transfer"])):
        paths[stream] = new_folder(spark, stream)
        rows = broken
        for kind in kinds:
            rows = rows.unionByName(made[kind])
        rows.select(F.encode("value", "UTF-8").alias("value")).write.parquet(paths[stream])
    out = new_folder(spark, "topics")
    read = lambda stream: jobs.read_files(spark, paths[stream], spark.createDataFrame([], "value binary").schema)
    sink = lambda rows, n, topic: sinks.commit(_essence(rows, topic), n, out, topic)
    for query in jobs.start_engine(read("trading"), read("liquidity"), EngineConfig(session_gap_seconds=GAP), sink, new_folder(spark, "engine"), availableNow=True):
        _finish(query)
    return sinks.committed(spark, out, "topic string, id string, number double, text string, n int")


def _essence(rows: DataFrame, topic: str) -> DataFrame:
    """What tells a row of a topic, and the values that most depend on the rest."""
    alert = F.concat_ws("|", "alertType", "pairAddress", "windowStart", "blockNumber", "attackerAddress")
    columns = {
        "trading-analytics": ("windowId", "twap", "totalVolume0", "uniqueTraders"), "market-trends": ("windowId", "avgPrice", "trend", "swapCount"),
        "liquidity-analytics": ("windowId", F.lit(None), "netLpTokenChange", "uniqueProviders"), "pattern-analytics": (alert, "estimatedProfitUSD", F.array_join("involvedTransactions", ","), "involvedEventCount"),
        sinks.ERRORS: ("stream", F.lit(None), "reason", "payloadSize"),
    }[topic]
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return rows.select(F.lit(topic).alias("topic"), *[c.cast(kind).alias(name) for c, name, kind in zip(named, ("id", "number", "text", "n"), ("string", "double", "string", "int"), strict=True)])


def _on_events(plan):
    return lambda spark, sf_dir: plan(exchange_events(spark, sf_dir))


QUERIES = {
    "parse_amounts": _on_events(parse_amounts),
    "usd_volume_rules": _on_events(usd_volume_rules),
    "long_sums": _on_events(long_sums),
    "event_times": _on_events(event_times),
    "alert_descriptions": _on_events(alert_descriptions),
    "parsed_logs": parsed_logs,
    "subscribed_logs": subscribed_logs,
    "enriched_logs": enriched_logs,
    "avro_liquidity": _on_events(avro_liquidity),
    "json_records": _on_events(json_records),
    "result_rows": _on_events(result_rows),
    "empty_record": _on_events(empty_record),
    "stored_windows": stored_windows,
    "expired_days": expired_days,
    "stream_trading": _appended(jobs.trading_stream),
    "stream_trends": _appended(jobs.trend_stream),
    # The gate holds what it is given: only the columns that are asked for, and what it looks at.
    "stream_finality": _appended(lambda e: jobs.finality_gate(e.select("pairAddress", "blockNumber", "seq", "price", "volumeUSD", "eventType"), 64).drop("eventType"), few=True),
    "stream_liquidity": _sunk(lambda e, sink, at: jobs.start_liquidity(e, 60, sink, at, availableNow=True), liquidity.liquidity_windows),
    "stream_alerts": _sunk(lambda e, sink, at: jobs.start_alerts(e, GAP, lambda rows, n: sink(rows.drop("alertId", "description"), n), at, availableNow=True), lambda e: sessions.alerts(e, GAP).drop("alertId", "description")),
    "stream_engine": stream_engine,
    "stream_enriched": stream_enriched,
    "stream_prices": stream_prices,
    "finality_pending": finality_pending,
    "stored_counts": stored_counts,
    "stream_topic": stream_topic,
    "stream_late": stream_late,
    "stream_retracted": stream_retracted,
    "stream_logs": stream_logs,
}

#: Amounts in decimal text are cents and sixteen zeros in the tables.
_X = "CASE kind WHEN 'Transfer' THEN cents + 5 WHEN 'Swap' THEN CASE WHEN even THEN cents + 1 ELSE 0 END ELSE cents + 3 END::HUGEINT * 10000000000000000"
_LOGS = """WITH l AS (
  SELECT event_id AS seq, event_id % 13 AS f, CASE WHEN event_type IN ('purchase', 'click') THEN 'Swap' WHEN event_type = 'signup' THEN 'Mint' WHEN event_type = 'error' THEN 'Burn' WHEN event_type = 'view' THEN 'Transfer' END AS kind,
    CAST(round(value * 100) AS BIGINT) AS c, user_id % 4 AS u, (user_id // 4) % 4 + 1 AS v, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS block, event_id // 2 AS tx, (event_id // 2) % 3 AS pool FROM events),
p AS (
  SELECT *, CASE WHEN f <> 7 THEN kind END AS ty, CASE WHEN f = 7 THEN 'unknown event' WHEN f = 6 THEN 'missing topics' WHEN f = 5 AND kind <> 'Transfer' THEN 'short data' WHEN f = 8 THEN 'data is not hexadecimal' WHEN u = 0 THEN 'zero address' END AS err,
    '0x' || repeat('0', 39) || u AS a1, '0x' || repeat('0', 39) || v AS a2 FROM l WHERE kind IS NOT NULL)"""
_ALL = "115792089237316195423570985008687907853269984665640564039457584007913129639935"
_CLOSED = lambda rows: f""" WHERE "windowEnd" <= (SELECT max(t) - 60 FROM {rows}) * 1000"""
_FOUND = SANDWICH.replace("found AS", "found_s AS", 1) + JIT.removeprefix(SESSIONS).replace("found AS", "found_j AS", 1)
_EMPTY = {"long": "0::BIGINT", "int": "0", "double": "0.0::DOUBLE"}

SQL = {
    "parse_amounts": EV + f""", x AS (SELECT seq, {_X} AS x FROM e),
y AS (SELECT seq, x, CASE seq % 10 WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN -x WHEN 6 THEN x WHEN 8 THEN x WHEN 9 THEN -x ELSE 0 END AS y FROM x)
SELECT seq, CASE WHEN seq % 10 = 9 AND x <> 0 THEN '-' || repeat(x::VARCHAR, 15) ELSE y::VARCHAR END AS amount, sign(y)::INTEGER AS sign, CASE seq % 3 WHEN 0 THEN 'BB' WHEN 1 THEN 'CC' ELSE 'AA' END AS symbol FROM y""",
    "long_sums": EV + "," + LIQUIDITY + """, z AS (SELECT *, CASE WHEN "mintCount" + "burnCount" > 0 THEN repeat('0', 200) END AS z FROM lw)
SELECT "windowId", CASE "totalMintAmount0" WHEN '0' THEN '0' ELSE "totalMintAmount0" || z END AS "totalMintAmount0", CASE "totalBurnAmount0" WHEN '0' THEN '0' ELSE "totalBurnAmount0" || z END AS "totalBurnAmount0",
  CASE "netLiquidityChange0" WHEN '0' THEN '0' ELSE "netLiquidityChange0" || z END AS "netLiquidityChange0" FROM z WHERE z IS NOT NULL""",
    "usd_volume_rules": EV + """, v AS (SELECT seq, a0::DOUBLE / 1e18::DOUBLE AS v0, a1::DOUBLE / 1e16::DOUBLE AS v1 FROM s)
SELECT seq, round(CASE seq % 5 WHEN 0 THEN v1 WHEN 1 THEN v0 WHEN 2 THEN v0 * 3 WHEN 3 THEN v1 * 2 ELSE v0 * (v1 / v0) END, 6) AS usd FROM v""",
    "event_times": EV + """SELECT seq, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time, 'com.dex.events.' || lower(kind) AS type, tx || ':' || li AS id FROM e""",
    "alert_descriptions": EV + "," + _FOUND + """, texts AS (
  SELECT "alertType", "windowStart", "pairAddress", "blockNumber", "attackerAddress", printf('%s traded around %d swaps of others in block %d', "attackerAddress", len("victimAddresses"), "blockNumber") AS description FROM found_s
  UNION ALL SELECT 'JIT_LIQUIDITY', ws, pair, mb, sender, printf('%s put in and took out liquidity around swaps in blocks %d to %d', sender, mb, kb) FROM jp JOIN jb USING (pair, ws, mb, kb))
SELECT * FROM texts""",
    "parsed_logs": _LOGS + f"""SELECT seq, ty AS "eventType", err AS error, CASE WHEN err IS NULL AND kind <> 'Transfer' THEN a1 END AS sender, CASE WHEN err IS NULL AND kind IN ('Swap', 'Burn') THEN a2 END AS recipient,
  CASE WHEN err IS NULL AND kind = 'Transfer' THEN a1 END AS "from", CASE WHEN err IS NULL AND kind = 'Transfer' THEN a2 END AS "to",
  CASE WHEN err IS NULL AND kind = 'Swap' THEN (c + 1)::VARCHAR END AS "amount0In", CASE WHEN err IS NULL AND kind = 'Swap' THEN '0' END AS "amount1In", CASE WHEN err IS NULL AND kind = 'Swap' THEN '0' END AS "amount0Out", CASE WHEN err IS NULL AND kind = 'Swap' THEN (c + 2)::VARCHAR END AS "amount1Out",
  CASE WHEN err IS NULL AND kind IN ('Mint', 'Burn') THEN (c + 3)::VARCHAR END AS amount0, CASE WHEN err IS NULL AND kind IN ('Mint', 'Burn') THEN '{_ALL}' END AS amount1,
  CASE WHEN err IS NULL AND kind = 'Transfer' THEN CASE WHEN f = 5 THEN '18' WHEN f = 9 THEN '0' ELSE (c + 5)::VARCHAR END END AS value FROM p""",
    "subscribed_logs": _LOGS + """SELECT seq, block AS "blockNumber", 'pool-' || pool AS address FROM l WHERE kind IS NOT NULL AND f <> 7 AND pool <> 2 AND block >= (SELECT max(block) - 100 FROM l WHERE kind IS NOT NULL)""",
    "enriched_logs": _LOGS + """SELECT 'tx-' || tx || ':' || seq AS "eventId", kind AS "eventType", block * 3600 + 7 AS "blockTimestamp", 'pool-' || pool AS "pairAddress",
  CASE pool WHEN 0 THEN 'AAA' WHEN 2 THEN repeat('x', 20) END AS "token0Symbol", CASE pool WHEN 1 THEN repeat('é', 10) END AS "token1Symbol",
  CASE WHEN kind = 'Swap' THEN round((c + 2)::DOUBLE / ((c + 1)::DOUBLE / 100), 8) END AS price,
  CASE WHEN kind = 'Swap' THEN round(CASE pool WHEN 0 THEN (c + 1)::DOUBLE / 100 * (block // 24 + 0.5::DOUBLE) WHEN 1 THEN (c + 2)::DOUBLE ELSE (c + 1)::DOUBLE / 100 * ((c + 2)::DOUBLE / ((c + 1)::DOUBLE / 100)) END, 6) END AS "volumeUSD",
  CASE WHEN kind = 'Swap' THEN CASE WHEN tx % 3 <> 1 THEN tx + 21000 ELSE 0 END END AS "gasUsed", CASE WHEN kind = 'Swap' THEN CASE WHEN tx % 3 = 0 THEN tx::VARCHAR ELSE '0' END END AS "gasPrice" FROM p WHERE err IS NULL""",
    "avro_liquidity": EV + """SELECT kind AS "eventType", tx || ':' || li AS "eventId", block AS "blockNumber", t AS "blockTimestamp", tx AS "transactionHash", li AS "logIndex", pair AS "pairAddress", 'token-a' AS token0, 'token-b' AS token1, sym0 AS "token0Symbol", sym1 AS "token1Symbol",
  CASE WHEN kind <> 'Transfer' THEN 'T' || sender[2:] END AS sender, CASE WHEN kind = 'Burn' THEN 'T' || recipient[2:] END AS recipient,
  CASE WHEN kind <> 'Transfer' THEN ((cents + 3)::HUGEINT * 10000000000000000)::VARCHAR END AS amount0, CASE WHEN kind <> 'Transfer' THEN ((cents + 4)::HUGEINT * 10000000000000000)::VARCHAR END AS amount1,
  CASE WHEN kind = 'Transfer' THEN 'T' || sender[2:] END AS "from", CASE WHEN kind = 'Transfer' THEN 'Trader-' || ((user_id + 1) % 4) END AS "to", CASE WHEN kind = 'Transfer' THEN ((cents + 5)::HUGEINT * 10000000000000000)::VARCHAR END AS value, t AS "eventTimestamp" FROM e WHERE kind <> 'Swap'""",
    "json_records": EV + "," + LIQUIDITY + "SELECT to_json({" + ", ".join(f"'{c}': \"{c}\"" for c in api.FLOWS) + "})::VARCHAR AS value FROM lw",
    "result_rows": TW + """SELECT "windowId", "pairAddress", twap, "volumeUSD", "totalVolume0", "swapCount", "repeatedTraders", NULL::VARCHAR AS refused FROM tw WHERE "windowStart" % 1500000 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*)::INTEGER, NULL, 'no data' FROM tw WHERE "windowStart" % 1500000 = 0""",
    "empty_record": EV + "," + _windows(60) + """, span AS (SELECT "pairAddress" AS pair, min("windowStart") AS a, max("windowStart") AS b FROM tw GROUP BY 1),
hours AS (SELECT pair, unnest(range(a, b + 1, 3600000)) AS ws FROM span), gaps AS (SELECT * FROM hours h WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw."pairAddress" = h.pair AND tw."windowStart" = h.ws))
SELECT """ + ", ".join({"windowId": "pair || ':' || ws || ':' || (ws + 3600000)", "windowStart": "ws", "windowEnd": "ws + 3600000", "pairAddress": "pair", "token0Symbol": "NULL::VARCHAR", "token1Symbol": "NULL::VARCHAR", "totalVolume0": "'0'", "totalVolume1": "'0'", "largestSwapValue": "'0'", "largestSwapAddress": "''", "averageGasPrice": "'0'", "volumeUSD": "NULL::DOUBLE", "repeatedTraders": "CAST([] AS VARCHAR[])"}.get(f.name, _EMPTY.get(f.dataType.simpleString().replace("bigint", "long"), "")) + f' AS "{f.name}"' for f in schemas.TRADING.fields if f.name != "processedAt") + " FROM gaps",
    "stored_windows": TW + "SELECT * FROM tw",
    "expired_days": TW + f"""SELECT "windowId", "windowStart", "pairAddress", twap FROM tw WHERE "windowStart" >= ({NOW} - 168 * 3600000) // 86400000 * 86400000""",
    "stream_trading": TW + "SELECT * FROM tw" + _CLOSED("s"),
    "stream_trends": EV + "," + TRENDS + "SELECT * FROM mt" + _CLOSED("s"),
    "stream_liquidity": EV + "," + LIQUIDITY + "SELECT * FROM lw" + _CLOSED("e WHERE kind <> 'Swap'"),
    "stream_alerts": EV + "," + _FOUND + """, every AS (SELECT * FROM found_s UNION ALL SELECT * FROM found_j) SELECT *, "windowEnd" AS "detectedAt" FROM every""" + _CLOSED("e"),
    "stream_engine": TW + "," + LIQUIDITY + "," + TRENDS + "," + _FOUND + """, every AS (SELECT * FROM found_s UNION ALL SELECT * FROM found_j)
SELECT 'trading-analytics' AS topic, "windowId" AS id, twap AS number, "totalVolume0" AS text, "uniqueTraders" AS n FROM tw""" + _CLOSED("s") + """ UNION ALL SELECT 'market-trends', "windowId", "avgPrice", trend, "swapCount" FROM mt""" + _CLOSED("s")
    + """ UNION ALL SELECT 'liquidity-analytics', "windowId", NULL, "netLpTokenChange", "uniqueProviders" FROM lw""" + _CLOSED("e WHERE kind <> 'Swap'")
    + """ UNION ALL SELECT 'pattern-analytics', "alertType" || '|' || "pairAddress" || '|' || "windowStart" || '|' || "blockNumber" || '|' || "attackerAddress", "estimatedProfitUSD", array_to_string("involvedTransactions", ','), "involvedEventCount" FROM every""" + _CLOSED("e")
    + """ UNION ALL SELECT 'deserialization-errors', stream, NULL, reason, size FROM (VALUES ('trading'), ('liquidity')) AS s(stream), (VALUES ('INVALID_ENVELOPE', 11), ('UNSUPPORTED_EVENT_TYPE', 62)) AS r(reason, size)""",
    "stream_enriched": _LOGS + """, x AS (SELECT *, CASE WHEN err IS NULL AND (block % 17 = 3 OR block % 11 = 5) THEN 'unknown block' ELSE err END AS refused FROM p)
SELECT 'tx-' || tx || ':' || seq AS "eventId", CASE WHEN refused IS NULL THEN kind END AS "eventType", CASE WHEN refused IS NULL THEN block * 3600 + 7 END AS "blockTimestamp", CASE WHEN refused IS NULL THEN 'pool-' || pool END AS "pairAddress",
  CASE WHEN refused IS NULL THEN CASE pool WHEN 0 THEN 'AAA' WHEN 2 THEN repeat('x', 20) END END AS "token0Symbol", CASE WHEN refused IS NULL AND pool = 1 THEN repeat('é', 10) END AS "token1Symbol",
  CASE WHEN refused IS NULL AND kind = 'Swap' THEN round((c + 2)::DOUBLE / ((c + 1)::DOUBLE / 100), 8) END AS price,
  CASE WHEN refused IS NULL AND kind = 'Swap' THEN round(CASE pool WHEN 0 THEN (c + 1)::DOUBLE / 100 * (block // 24 + 0.5::DOUBLE) WHEN 1 THEN (c + 2)::DOUBLE ELSE (c + 1)::DOUBLE / 100 * ((c + 2)::DOUBLE / ((c + 1)::DOUBLE / 100)) END, 6) END AS "volumeUSD",
  CASE WHEN refused IS NULL AND kind = 'Swap' THEN CASE WHEN tx % 3 <> 1 AND tx % 7 <> 3 THEN tx + 21000 ELSE 0 END END AS "gasUsed", CASE WHEN refused IS NULL AND kind = 'Swap' THEN CASE WHEN tx % 3 = 0 AND tx % 7 <> 3 THEN tx::VARCHAR ELSE '0' END END AS "gasPrice", refused FROM x""",
    "stream_prices": """WITH r AS (SELECT 'token-' || (l_partkey % 50) AS token, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) + l_linenumber * 3600 + l_orderkey % 3600 AS at, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS answer FROM lineitem GROUP BY ALL),
a AS (SELECT DISTINCT 'token-' || (o_custkey % 50) AS token, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + 43200 AS at FROM orders)
SELECT a.token, a.at, CASE WHEN a.at - r.at <= 86400 THEN round(r.answer::DOUBLE / 1e8, 8) END AS usd FROM a ASOF LEFT JOIN r ON a.token = r.token AND a.at >= r.at
WHERE a.at <= least((SELECT max(x."at") FROM a x), (SELECT max(x."at") FROM r x)) - 172800""",
    "finality_pending": EV + """SELECT pair AS "pairAddress", tip, count(DISTINCT block) FILTER (WHERE tip < 64 OR block > tip - 64) AS "pendingBlocks", count(*) FILTER (WHERE tip < 64 OR block > tip - 64) AS "pendingEvents" FROM (SELECT *, max(block) OVER (PARTITION BY pair) AS tip FROM e) GROUP BY pair, tip""",
    "stored_counts": TW + """SELECT "pairAddress", 2 * count(*) AS rows, count(*) AS stored FROM tw GROUP BY 1""",
    "stream_logs": _LOGS + """, cut AS (SELECT min(block) + (max(block) - min(block)) * 2 // 3 AS top FROM p)
SELECT seq, block AS "blockNumber", 'pool-' || pool AS address FROM p WHERE ty IS NOT NULL AND pool <> 2 AND block >= (SELECT max(block) - 100 FROM p, cut WHERE block < top)""",
    "stream_topic": TW + """SELECT "pairAddress" AS key, "windowId", twap, "swapCount" FROM tw""" + _CLOSED("s"),
    "stream_retracted": EV + "," + _windows(5, "seq % 10 <> 0 OR seq % 30 = 0") + "SELECT * FROM tw",
    "stream_late": EV + """, size AS (SELECT max(seq) + 1 AS n FROM ev),
f AS (SELECT s.*, (t // 300 + 1) * 300 AS over, CAST(floor((seq + CASE WHEN seq % 50 = 0 THEN n // 7 ELSE 0 END) * 6 / (n + n // 7)) AS INTEGER) AS part FROM s, size),
w AS (SELECT k, (SELECT max(t) - 60 FROM f WHERE part <= k) AS wm FROM range(6) AS parts(k)),
kept AS (SELECT * FROM f WHERE over > coalesce((SELECT wm FROM w WHERE k = CASE f.part WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 3 END), 0)),
""" + _windows(5).replace("FROM s WHERE", "FROM kept WHERE") + "SELECT * FROM tw" + _CLOSED("s"),
    "stream_finality": EV + """SELECT pair AS "pairAddress", block AS "blockNumber", seq, CASE WHEN kind = 'Swap' THEN price END AS price, CASE WHEN kind = 'Swap' THEN usd END AS "volumeUSD" FROM (SELECT *, max(block) OVER (PARTITION BY pair) AS tip FROM e) WHERE tip >= 64 AND block <= tip - 64""",
}
