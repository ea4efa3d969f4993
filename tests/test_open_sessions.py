"""Sessions on streams are held as rows of many events, and never as one row with all of them."""

from pyspark.sql import functions as F

from tests.test_engine import events, swap
from tests.test_stream_state import arriving, drained
from tidemark.streaming import jobs, keyed

T0 = 1_700_000_000


def test_sessions_close_over_several_triggers(spark, tmp_path):
    at = lambda *times, pool="0xPair": events(spark, *[swap(blockTimestamp=T0 + t, pairAddress=pool) for t in times])
    parts = [at(0, 5, 100, 160), at(3, 8, 130).unionByName(at(50, pool="other")), at(400), at(0, 170, 395), at(1_000)]
    stream = jobs.with_lateness(arriving(spark, str(tmp_path / "in"), *parts))
    out = str(tmp_path / "out")
    got = lambda: spark.read.schema(parts[0].schema).parquet(out)
    drained(jobs.start_append(keyed.closed_sessions(stream, 30), out, str(tmp_path / "c"), availableNow=True))
    seen = sorted((r.pairAddress, r.blockTimestamp - T0) for r in got().select("pairAddress", "blockTimestamp").collect())
    # 0 of the fourth trigger is late by then; 170 finds its session still held, 395 is in time, and in the session of 400.
    assert seen == [("0xPair", t) for t in (0, 3, 5, 8, 100, 130, 160, 170, 395, 400)] + [("other", 50)]
    assert got().where(F.col("amount0In").isNull()).count() == parts[0].where(F.col("amount0In").isNull()).count()


def test_a_session_is_not_gathered_in_one_row(spark, tmp_path):
    events(spark, *[swap(blockTimestamp=T0 + t) for t in range(40)]).repartition(4).write.parquet(str(tmp_path / "in"))
    df = events(spark, swap())
    stream = jobs.with_lateness(jobs.read_files(spark, str(tmp_path / "in"), df.schema))
    query = jobs.start_alerts(stream, 30, lambda rows, n: rows.write.format("noop").mode("append").save(), at := str(tmp_path / "c"), availableNow=True)
    drained(query)
    held = spark.read.format("statestore").option("path", at).option("stateVarName", "parts").load()
    assert held.count() > 1
