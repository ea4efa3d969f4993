"""Sessions of events, and the trading patterns found inside them: sandwiches and just-in-time liquidity.

Everything is windows and equi-joins. Events of a session are those of one pool without a pause longer than the gap;
starts are found within days first and carried over day borders by a table of one row per pool and day, so that a hot
pool does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

DAY = 86_400
#: Swaps of a block that are looked up together.
STRETCH = 16
#: Mints or burns of a provider and block that are joined as one list.
LISTED = 256
#: A row that stands for the alerts of so many mints and so many burns is copied at a time.
COPIED = 64


def sessions(events: DataFrame, gap: int, bucket: int = DAY) -> DataFrame:
    """pairAddress, blockTimestamp, windowStart, windowEnd (seconds; the end is the last event plus the gap) of each event time. A pause of just the gap does not end a session."""
    times = events.select("pairAddress", "blockTimestamp").distinct().withColumn("_b", F.floor(F.col("blockTimestamp") / bucket))
    inside = Window.partitionBy("pairAddress", "_b").orderBy("blockTimestamp")
    across = Window.partitionBy("pairAddress").orderBy("_b")
    last = times.groupBy("pairAddress", "_b").agg(F.max("blockTimestamp").alias("_last"))
    before = last.select("pairAddress", "_b", F.lag("_last").over(across).alias("_before"))
    marked = times.withColumn("_previous", F.lag("blockTimestamp").over(inside)).join(before, ["pairAddress", "_b"])
    previous = F.coalesce("_previous", "_before")
    starts = F.when(previous.isNull() | (F.col("blockTimestamp") - previous > gap), F.col("blockTimestamp"))
    marked = marked.withColumn("_start", starts)
    latest = marked.groupBy("pairAddress", "_b").agg(F.max("_start").alias("_s"))
    carried = latest.select("pairAddress", "_b", F.last("_s", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    known = marked.join(carried, ["pairAddress", "_b"]).withColumn("windowStart", F.coalesce(F.max("_start").over(inside), "_carry"))
    ends = known.groupBy("pairAddress", "windowStart").agg((F.max("blockTimestamp") + gap).alias("windowEnd"))
    return known.select("pairAddress", "blockTimestamp", "windowStart").join(ends, ["pairAddress", "windowStart"])


def in_sessions(events: DataFrame, gap: int) -> DataFrame:
    """events with windowStart and windowEnd of their session, in seconds."""
    return events.join(sessions(events, gap), ["pairAddress", "blockTimestamp"])


def session_summary(events: DataFrame, gap: int) -> DataFrame:
    """Sessions with their events and swaps, in milliseconds."""
    found = in_sessions(events, gap).groupBy("pairAddress", "windowStart", "windowEnd").agg(F.count("*").alias("eventCount"), F.count_if(F.col("eventType") == "Swap").alias("swapCount"))
    return found.select("pairAddress", (F.col("windowStart") * 1000).alias("windowStart"), (F.col("windowEnd") * 1000).alias("windowEnd"), "eventCount", "swapCount")


def _symbols(events: DataFrame) -> DataFrame:
    """First symbols of a session, from swaps and mints."""
    first = lambda k: F.min(F.when(F.col(f"token{k}Symbol").isNotNull(), F.struct("blockTimestamp", "logIndex", "seq", F.col(f"token{k}Symbol").alias("v")))).alias(f"_s{k}")
    found = events.where(F.col("eventType").isin("Swap", "Mint")).groupBy("pairAddress", "windowStart").agg(first(0), first(1))
    return found.select("pairAddress", "windowStart", F.col("_s0.v").alias("token0Symbol"), F.col("_s1.v").alias("token1Symbol"))


def _alert(kind: str, found: DataFrame, description: Column) -> DataFrame:
    key = F.concat_ws("|", F.lit(kind), "pairAddress", "windowStart", "_key")
    return found.select(
        F.sha2(key, 256).alias("alertId"), F.lit(kind).alias("alertType"), (F.col("windowStart") * 1000).alias("windowStart"), (F.col("windowEnd") * 1000).alias("windowEnd"), "pairAddress",
        "token0Symbol", "token1Symbol", "blockNumber", "attackerAddress", "victimAddresses", "estimatedProfitUSD", "involvedSwapCount", "involvedEventCount", "severity", description.alias("description"), "involvedTransactions",
    )


def sandwiches(events: DataFrame, gap: int) -> DataFrame:
    return sandwich_alerts(in_sessions(events, gap))


def jit_liquidity(events: DataFrame, gap: int) -> DataFrame:
    return jit_alerts(in_sessions(events, gap))


#: What tells a block of a session.
BLOCK = ["pairAddress", "windowStart", "blockNumber"]


def _runs(events: DataFrame, counted: bool = False) -> DataFrame:
    """Swaps with their place in the block (at) and their run of one sender; counted: also with how many swaps of the block up to
    them have a sender (known), and their place among those of their own (own)."""
    direction = S.swap_direction(F.col("amount0In"), F.col("amount1In"), F.col("amount0Out"), F.col("amount1Out"))
    order = ["logIndex", "blockTimestamp", "seq"]
    ordered, own = Window.partitionBy(*BLOCK).orderBy(*order), Window.partitionBy(*BLOCK, "who").orderBy("at")
    swaps = events.where((F.col("eventType") == "Swap") & F.col("blockNumber").isNotNull()).select(*BLOCK, "windowEnd", S.address(F.col("sender")).alias("who"), direction.alias("way"), "volumeUSD", "transactionHash", *order)
    swaps = swaps.withColumn("at", F.row_number().over(ordered)).withColumn("_new", (~F.lag("who").over(ordered).eqNullSafe(F.col("who"))).cast("int"))
    if counted:
        swaps = swaps.withColumn("known", F.count("who").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("own", F.row_number().over(own))
    return swaps.withColumn("run", F.sum("_new").over(ordered)).drop("_new", *order)


def _fronts(swaps: DataFrame, *more: str) -> DataFrame:
    """Swaps that are the front of a sandwich, with what is known of their back; more: further columns of the back."""
    # Later runs come first in this order, so that each row adds to what is known of them, and none looks through them again.
    later = Window.partitionBy(*BLOCK, "who").orderBy(F.desc("run")).rangeBetween(Window.unboundedPreceding, -1)
    not_way = lambda way: F.min(F.when(F.col("way") != way, F.struct("at", "volumeUSD", *more))).over(later)
    back = F.when(F.col("way") == "BUY_TOKEN0", not_way("BUY_TOKEN0")).when(F.col("way") == "BUY_TOKEN1", not_way("BUY_TOKEN1"))
    return swaps.withColumn("back", back).where("back is not null").withColumnRenamed("who", "attackerAddress")


def _around(others: Column) -> Column:
    return F.format_string("%s traded around %d swaps of others in block %d", "attackerAddress", others, "blockNumber")


def _in_and_out() -> Column:
    return F.format_string("%s put in and took out liquidity around swaps in blocks %d to %d", "attackerAddress", "blockNumber", "_to")


def sandwich_alerts(events: DataFrame) -> DataFrame:
    """For each front swap, the first later swap of its sender in the block, the other way round, with others in between.

    A swap by another sender lies in between exactly if the back swap is in a later run of swaps by the sender. So the
    back swap is the least position in later runs with a different direction: a window over runs, not a self-join.
    """
    block, swaps = BLOCK, _runs(events)
    fronts = _fronts(swaps).select(*block, "windowEnd", "attackerAddress", F.col("at").alias("_i"), F.col("back.at").alias("_j"), F.abs(F.col("back.volumeUSD") - F.col("volumeUSD")).alias("_p"))
    # A front looks through the stretches of its block that it spans, not through all of it.
    stretch = lambda at: F.floor(F.col(at) / STRETCH)
    spans = fronts.withColumn("_n", F.explode(F.sequence(stretch("_i"), stretch("_j"))))
    inside = spans.join(swaps.select(*block, "at", "who", "transactionHash", stretch("at").alias("_n")), [*block, "_n"]).where("at between _i and _j")
    keys = [*block, "windowEnd", "attackerAddress", "_i", "_j", "_p"]
    others = F.collect_list(F.when(F.col("who") != F.col("attackerAddress"), F.struct("at", "who")))
    found = inside.groupBy(*keys).agg(F.transform(F.array_sort(others), lambda x: x["who"]).alias("victimAddresses"), F.array_sort(F.collect_set("transactionHash")).alias("involvedTransactions"))
    profit, n = F.coalesce("_p", F.lit(0.0)), (F.col("_j") - F.col("_i") + 1).cast("int")
    found = found.select("*", profit.alias("estimatedProfitUSD"), n.alias("involvedSwapCount"), n.alias("involvedEventCount"), S.severity_of(profit).alias("severity"), F.concat_ws("|", "blockNumber", "_i", "_j").alias("_key"))
    return _alert("SANDWICH_ATTACK", found.join(_symbols(events), ["pairAddress", "windowStart"], "left"), _around(F.size("victimAddresses")))


def _with(known: Column, *more: Column) -> Column:
    """A sorted array of different texts with more of them, null last. What is sorted already is gone through once."""
    new = F.array_compact(F.array_distinct(F.array(*[F.when(~F.array_contains(known, x), x) for x in more])))
    none = F.when(F.greatest(*[x.isNull() for x in more]), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.sort_array(F.concat(known, new)), none)


def _listed(events: DataFrame, kind: str, name: str) -> DataFrame:
    """Events of a kind by provider and block, as lists of at most LISTED."""
    group = ["pairAddress", "windowStart", "windowEnd", "attackerAddress", "blockNumber"]
    rows = events.where(F.col("eventType") == kind).withColumn("attackerAddress", S.address(F.col("sender"))).select(*group, "transactionHash", "seq")
    part = F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("seq")) - 1) / LISTED)
    return rows.withColumn("_part", part).groupBy(*group, "_part").agg(F.collect_list(F.struct("transactionHash", "seq")).alias(name)).drop("_part")


def jit_alerts(events: DataFrame, reach: int = 2) -> DataFrame:
    """Each mint and burn of one provider at most `reach` blocks apart with a swap from the mint's block to the burn's.

    A burn before the mint has no blocks in between and gives none. Bands are equi-joins: lists of mints are filed under the few
    blocks that their burns may have, and blocks of swaps are looked up one by one.
    """
    key = ["pairAddress", "windowStart"]
    spark = events.sparkSession
    mints = _listed(events, "Mint", "_mints").withColumn("_to", F.explode(F.sequence(F.col("blockNumber"), F.col("blockNumber") + reach)))
    burns = _listed(events, "Burn", "_burns").drop("windowEnd").withColumnRenamed("blockNumber", "_to")
    pairs = mints.join(burns, [*key, "attackerAddress", "_to"])
    swaps = events.where(F.col("eventType") == "Swap").groupBy(*key, F.col("blockNumber").alias("_b")).agg(F.collect_set("transactionHash").alias("_swaps"))
    spans = mints.select(*key, F.col("blockNumber").alias("_from"), "_to").distinct().withColumn("_b", F.explode(F.sequence("_from", "_to")))
    between = spans.join(swaps, [*key, "_b"]).groupBy(*key, F.col("_from").alias("blockNumber"), "_to").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_swaps")))).alias("_swaps"))
    # What all pairs of a span share is made and sorted once, and comes to their lists last; pairs are made after that, so that none is
    # shuffled. The work of a task is that of its pairs, not of the rows that Spark sees, hence a fixed number of parts.
    dealt = lambda rows: rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, "blockNumber", "_to")
    found = dealt(pairs).join(dealt(between.join(_symbols(events), key, "left")), [*key, "blockNumber", "_to"])
    found = found.withColumn("_mint", F.explode("_mints")).drop("_mints").withColumn("_burn", F.explode("_burns")).drop("_burns")
    found = found.select("*", "_mint.transactionHash", "_mint.seq", F.col("_burn.transactionHash").alias("_tx"), F.col("_burn.seq").alias("_seq")).drop("_mint", "_burn")
    txs = _with(F.col("_swaps"), F.col("transactionHash"), F.col("_tx"))
    found = found.select(
        "*", F.array().cast("array<string>").alias("victimAddresses"), F.lit(0.0).alias("estimatedProfitUSD"), F.lit(0).alias("involvedSwapCount"), txs.alias("involvedTransactions"),
        F.size(txs).alias("involvedEventCount"), F.lit("MEDIUM").alias("severity"), F.concat_ws("|", "blockNumber", "_to", "seq", "_seq").alias("_key"),
    )
    return _alert("JIT_LIQUIDITY", found, _in_and_out())


def _jit_groups(events: DataFrame, reach: int = 2) -> DataFrame:
    """Blocks of mints (blockNumber) and of burns (_to) of a provider that give just-in-time alerts, with the numbers of mints and
    burns: as many alerts as their product, none of which is made."""
    key, is_kind = ["pairAddress", "windowStart"], lambda kind: F.col("eventType") == kind
    acts = events.where(F.col("eventType").isin("Swap", "Mint", "Burn")).groupBy(*key, "windowEnd", "blockNumber", S.address(F.col("sender")).alias("attackerAddress"))
    acts = acts.agg(F.count_if(is_kind("Mint")).alias("_mints"), F.count_if(is_kind("Burn")).alias("_burns"), F.count_if(is_kind("Swap")).alias("_swaps"))
    mints = acts.where("_mints > 0").drop("_burns", "_swaps").withColumn("_to", F.explode(F.sequence(F.col("blockNumber"), F.col("blockNumber") + reach)))
    burns = acts.where("_burns > 0").select(*key, "attackerAddress", F.col("blockNumber").alias("_to"), "_burns")
    swaps = acts.where("_swaps > 0").select(*key, F.col("blockNumber").alias("_b")).distinct()
    spans = mints.select(*key, "blockNumber", "_to").distinct().withColumn("_b", F.explode(F.sequence("blockNumber", "_to")))
    around = spans.join(swaps, [*key, "_b"]).select(*key, "blockNumber", "_to").distinct()
    return mints.join(burns, [*key, "attackerAddress", "_to"]).join(around, [*key, "blockNumber", "_to"])


def _copies(rows: DataFrame, a: str, b: str, parts: int) -> DataFrame:
    """Each row a * b times. Rows are cut into ones of at most COPIED squared copies and dealt out, as Spark holds all copies of a row
    at once."""
    cut = lambda n, k: F.least(F.lit(COPIED), F.col(n) - F.col(k) * COPIED)
    for n, k in ((a, "_a"), (b, "_b")):
        rows = rows.withColumn(k, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / COPIED).cast("int"))))
    dealt = rows.withColumn("_n", (cut(a, "_a") * cut(b, "_b")).cast("int")).drop("_a", "_b", a, b).repartition(parts)
    return dealt.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_", "_n")


def descriptions(events: DataFrame, gap: int) -> DataFrame:
    """The alerts of both kinds with what they say, but without what they list: swaps of others are counted, and alerts that say the
    same are made from their number."""
    inside, parts = in_sessions(events, gap), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = lambda kind, rows, text: rows.select(F.lit(kind).alias("alertType"), (F.col("windowStart") * 1000).alias("windowStart"), "pairAddress", "blockNumber", "attackerAddress", text.alias("description"))
    # Texts are made before the rows are dealt out anew, and copied after that.
    copied = _copies(_jit_groups(inside).withColumn("description", _in_and_out()), "_mints", "_burns", parts)
    others = F.when(F.col("attackerAddress").isNull(), 0).otherwise(F.col("back.known") - F.col("known") - (F.col("back.own") - F.col("own")))
    return said("SANDWICH_ATTACK", _fronts(_runs(inside, counted=True), "known", "own"), _around(others)).unionByName(said("JIT_LIQUIDITY", copied, F.col("description")))


def alert_counts(events: DataFrame, gap: int) -> DataFrame:
    """pairAddress, detectedAt and alerts: the number of alerts() of each session, without any of them."""
    inside = in_sessions(events, gap)
    counted = _fronts(_runs(inside)).select("pairAddress", "windowEnd", F.lit(1).cast("long").alias("n"))
    counted = counted.unionByName(_jit_groups(inside).select("pairAddress", "windowEnd", (F.col("_mints") * F.col("_burns")).alias("n")))
    return counted.groupBy("pairAddress", (F.col("windowEnd") * 1000).alias("detectedAt")).agg(F.sum("n").alias("alerts"))


def alerts(events: DataFrame, gap: int) -> DataFrame:
    """Both kinds, with detectedAt at the end of the session, which is when a batch knows of it."""
    inside = in_sessions(events, gap)
    return sandwich_alerts(inside).unionByName(jit_alerts(inside)).withColumn("detectedAt", F.col("windowEnd"))
