"""Operators that keep state by key: the finality gate and open sessions by pool, and prices as of a time by token.

All keep their state in pieces (an entry for each block and part, an item for each round), so that a batch touches what it
adds and what it lets go, and not all that is held. What a running or stopped stream holds can be read from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from tidemark.operators.prices import STALE_SECONDS

#: An event of this type lets all held events of its pool go, as at a graceful end; it is not passed on itself.
FLUSH = "Flush"
#: Events without a block are filed here; only a flush lets them go.
NEVER = 1 << 62
#: Events of a pool that a batch puts into parts at a time, about.
PART_ROWS = 10_000
#: Seconds that an answer, or that there was none, is given again to later questions for the same token.
REMEMBERED_SECONDS = 300

_PREFIX = "spark.sql.streaming.stateStore."
#: A batch uploads what it changes, not a copy of all files. Packed events go to Python in batches of bounded size.
_ROCKSDB = {
    f"{_PREFIX}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_PREFIX}rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

#: A join of streams keeps one database for each part, not four, and those of an executor share this memory (in MB).
_JOINS = {"spark.sql.streaming.join.stateFormatVersion": "3", f"{_PREFIX}rocksdb.boundedMemoryUsage": "true", f"{_PREFIX}rocksdb.maxMemoryUsageMB": "1000"}
#: Parts that a join of streams keeps its state in, at most, if the cluster has no more cores than a quarter of it; else four for each
#: core. Each part has databases of its own, with files and memory that do not depend on what they hold.
JOIN_PARTS = 48


def _few_parts(spark: SparkSession) -> dict[str, str]:
    most = max(JOIN_PARTS, 4 * spark.sparkContext.defaultParallelism)
    return {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), most))}


@contextmanager
def rocksdb(spark: SparkSession, joins: bool = False, few: bool = False):
    """Streams that are started inside keep their state in RocksDB, on disk and in pieces; the session is left as it was."""
    settings = _ROCKSDB | (_JOINS if joins else {}) | (_few_parts(spark) if joins or few else {})
    was = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def started(results: DataFrame, writer: DataStreamWriter, checkpoint: str, trigger: dict, joins: bool = False, few: bool = False) -> StreamingQuery:
    """Starts a stream that keeps its state in RocksDB; joins: it joins streams with one another; few: its state has few keys, and is
    kept in as few parts as that of a join."""
    with rocksdb(results.sparkSession, joins, few):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


#: What tells of a pool's events of a block, without its columns being looked into, and the part of the gate that it goes to.
_PACKED = "pairAddress string, block long, flush boolean, rows binary, events long, shard int"
#: Bytes of events that are packed together, about.
PACK_BYTES = 32 << 20
#: Parts that the gate deals the blocks of a pool to. Each hears of the pool's latest block with every batch.
GATE_PARTS = 8


def _stream_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _tables_of(rows: bytes) -> Iterator[pa.Table]:
    """The tables of Arrow streams that stand one after another."""
    source = pa.BufferReader(rows)
    while source.tell() < len(rows):
        yield pa.ipc.open_stream(source).read_all()


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pool and block in a batch one row: its events as an Arrow stream, in which every value keeps all its digits, and
    their number; a flush of a pool is a row without events."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        flush = pc.fill_null(pc.equal(table["eventType"], FLUSH), False)
        out = [(pool, NEVER, True, None, 0) for pool in pc.unique(table.filter(flush)["pairAddress"]).to_pylist()]
        events = table.filter(pc.invert(flush)).combine_chunks()
        key = pa.table({"pool": events["pairAddress"], "block": pc.fill_null(events["blockNumber"], NEVER).cast(pa.int64())})
        order = pc.sort_indices(key, [("pool", "ascending"), ("block", "ascending")])
        events, key = events.take(order), key.take(order)
        pools, blocks = key["pool"].to_pylist(), key["block"].to_pylist()
        first = 0
        for k in range(1, len(pools) + 1):
            if k == len(pools) or (pools[k], blocks[k]) != (pools[first], blocks[first]):
                out.append((pools[first], blocks[first], False, _stream_of(events.slice(first, k - first)), k - first))
                first = k
        types = [batch.schema.field("pairAddress").type, pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types, strict=True)], ["pairAddress", "block", "flush", "rows", "events"])


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to PACK_BYTES, so that a pool's events of a block make few streams."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows with the part that their block goes to. All parts of a pool hear of its latest block, by rows without events, and
    of a flush."""
    for batch in batches:
        pools, blocks, flushes = (batch.column(c).to_pylist() for c in ("pairAddress", "block", "flush"))
        tips: dict[str | None, int] = {}
        for pool, block, flush in zip(pools, blocks, flushes, strict=True):
            if not flush and block != NEVER:
                tips[pool] = max(block, tips.get(pool, block))
        kept = [k for k, flush in enumerate(flushes) if not flush]
        known = batch.take(pa.array(kept, pa.int64()))
        shards = pa.array([blocks[k] % parts for k in kept], pa.int32())
        yield pa.RecordBatch.from_arrays([*known.columns, shards], [*known.schema.names, "shard"])
        told = [(pool, block, False) for pool, block in tips.items()] + [(pool, NEVER, True) for pool, flush in zip(pools, flushes, strict=True) if flush]
        rows = [(*row, None, 0, shard) for row in told for shard in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, [*batch.schema, pa.field("shard", pa.int32())], strict=True)], [*batch.schema.names, "shard"])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column("rows").to_pylist():
            table = pa.concat_tables(_tables_of(rows))
            yield from table.take(pc.sort_indices(table, [("seq", "ascending")], null_placement="at_start")).to_batches()


class _Gate(StatefulProcessor):
    """State of a part of a pool: the pool's latest block; for each block held, how many parts and events it has; the parts, as _packed makes them.
    Rows are never looked into here, so a pool with many events costs its one task little for each of them."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle) -> None:
        self.tip = handle.getValueState("tip", "block long")
        self.blocks = handle.getMapState("blocks", "block long", "parts int, events long")
        self.held = handle.getMapState("held", "block long, part int", "rows binary")

    def _hold(self, new: dict[int, list[tuple[bytes, int]]]) -> None:
        for block, packs in new.items():
            parts, events = self.blocks.getValue((block,)) or (0, 0)
            self.held.updateValue((block, parts), (b"".join(rows for rows, _ in packs),))
            self.blocks.updateValue((block,), (parts + 1, events + sum(n for _, n in packs)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tip, flush, new, waiting = self.tip.get()[0] if self.tip.exists() else -1, False, {}, 0
        for row in rows:
            if row["flush"]:
                flush = True
                continue
            block = row["block"]
            tip = max(tip, -1 if block == NEVER else block)
            if row["rows"] is None:  # tells of the latest block only
                continue
            new.setdefault(block, []).append((bytes(row["rows"]), row["events"]))
            waiting += row["events"]
            if waiting >= PART_ROWS:
                self._hold(new)
                new, waiting = {}, 0
        self._hold(new)
        self.tip.update((tip,))
        final = sorted(b for (b,) in list(self.blocks.keys()) if flush or self.depth <= tip and b <= tip - self.depth)
        for block in final:
            parts, _ = self.blocks.getValue((block,))
            out = []
            for part in range(parts):
                out.append(bytes(self.held.getValue((block, part))[0]))
                self.held.removeKey((block, part))
            self.blocks.removeKey((block,))
            yield Row(rows=b"".join(out))

    def close(self) -> None:
        pass


def finality_gate(events: DataFrame, depth: int = 64, parts: int = GATE_PARTS) -> DataFrame:
    """Holds events of a pool until its latest block is `depth` blocks ahead, then lets them go by block. Depth 0 passes all on.

    An event of type FLUSH lets go what is held whatever its depth. Events without a block wait for a flush. Blocks of a pool are
    dealt to `parts` keys of state, so that a hot pool does not meet in one task; a stream of very many pools needs no more than 1.
    The number cannot change while a checkpoint is used. Start it inside rocksdb(), or by started(), as the functions of jobs do.
    """
    if depth == 0:
        return events
    packed = events.mapInArrow(lambda batches: _dealt(_packed(_gathered(batches)), parts), _PACKED)
    return packed.groupBy("pairAddress", "shard").transformWithState(_Gate(depth), "rows binary", "Append", "None").mapInArrow(_unpacked, events.schema)


#: Events of a pool without a pause longer than the gap, with the times of the first and last (microseconds).
_STRETCHES = "pairAddress string, first long, last long, rows binary"


def _stretches(gap: int):
    """Cuts batches into stretches, whose events go on as one Arrow stream each; events without a time are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.is_valid(table["event_time"])).combine_chunks()
            times = table["event_time"].cast(pa.timestamp("us", table["event_time"].type.tz)).cast(pa.int64())
            order = pc.sort_indices(pa.table({"pool": table["pairAddress"], "time": times}), [("pool", "ascending"), ("time", "ascending")])
            table, times = table.take(order).combine_chunks(), times.take(order).to_numpy()
            pools = table["pairAddress"].to_pylist()
            other = np.array([a != b for a, b in zip(pools, pools[1:], strict=False)], bool)
            ends = [*(np.flatnonzero(other | (np.diff(times) > gap)) + 1).tolist(), len(pools)] if pools else []
            begins = [0, *ends[:-1]] if pools else []
            rows = [_stream_of(table.slice(a, b - a)) for a, b in zip(begins, ends, strict=True)]
            columns = [pa.array([pools[a] for a in begins], batch.schema.field("pairAddress").type), pa.array([int(times[a]) for a in begins], pa.int64()), pa.array([int(times[b - 1]) for b in ends], pa.int64()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["pairAddress", "first", "last", "rows"])

    return run


def _joined(spans: Iterable[tuple[int, int, int]], gap: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Spans (first, last, part) by session, each with the time of its last event."""
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    for span in sorted(spans):
        if out and span[0] - out[-1][0] <= gap:
            last, spans = out[-1]
            spans.append(span)
            out[-1] = (max(last, span[1]), spans)
        else:
            out.append((span[1], [span]))
    return out


class _Sessions(StatefulProcessor):
    """State of a pool: the spans of what it holds, the parts themselves, the next part's number and the time it wakes at.
    Events are never looked into here, and a session is never one row, however many events it has."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first long, last long, part long")
        self.parts = handle.getMapState("parts", "part long", "rows binary")
        self.next = handle.getValueState("next", "part long, wakes long, seen long")

    def _over(self, last: int, timerValues) -> bool:
        return last + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000

    def _wake(self, last: int) -> int:
        at = -(-(last + self.gap) // 1000) - 1  # timers go off once the watermark is past them
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, wakes, seen = self.next.get() if self.next.exists() else (0, None, 0)
        late = lambda last: last + self.gap <= seen * 1000  # noqa: E731 by the watermark that the pool was last looked at with
        new = []
        for row in rows:
            self.parts.updateValue((part,), (bytes(row["rows"]),))
            new.append((row["first"], row["last"], part))
            part += 1
        if any(late(last) for _, last, _ in new):  # late, unless they join what is held
            fresh = {span[2] for span in new}
            for last, spans in _joined([*map(tuple, self.spans.get()), *new], self.gap):
                if late(last) and fresh.issuperset(span[2] for span in spans):
                    for span in spans:
                        self.parts.removeKey((span[2],))
                        new.remove(span)
        if new:
            self.spans.appendList(new)
            soonest = min(last for _, last, _ in new)
            if wakes is None or soonest + self.gap < wakes * 1000:
                wakes = self._wake(soonest)
        self.next.update((part, wakes, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = []
        for last, spans in _joined(map(tuple, self.spans.get()), self.gap):
            if not self._over(last, timerValues):
                left.append((last, spans))
                continue
            for _, _, part in spans:
                yield Row(rows=bytes(self.parts.getValue((part,))[0]))
                self.parts.removeKey((part,))
        held = [span for _, spans in left for span in spans]
        self.spans.put(held) if held else self.spans.clear()
        part = self.next.get()[0]
        self.next.update((part, self._wake(min(last for last, _ in left)) if left else None, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap: int) -> DataFrame:
    """Events of a pool (with event_time under a watermark, and seq) once their session is over: the watermark is `gap` seconds past
    its last event. Events come out as they are, many to a row of state and none in one row with all of its session. Those
    whose session was over when their pool was last looked at are late, and left out unless they join one that is still held."""
    us = gap * 1_000_000
    stretches = events.mapInArrow(_stretches(us), _STRETCHES)
    return stretches.groupBy("pairAddress").transformWithState(_Sessions(us), "rows binary", "Append", "EventTime").mapInArrow(_unpacked, events.schema)


def _state(spark: SparkSession, checkpoint: str, name: str, operator: int) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name).load()


def pending(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """pairAddress, tip, pendingBlocks and pendingEvents of each pool that a finality gate has seen, after its last batch."""
    tips = _state(spark, checkpoint, "tip", operator).groupBy("key.pairAddress").agg(F.max("value.block").alias("tip"))
    held = _state(spark, checkpoint, "blocks", operator).groupBy("key.pairAddress").agg(F.count("*").alias("pendingBlocks"), F.sum("user_map_value.events").alias("pendingEvents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # A null pool is a pool too.
    held = held.withColumnRenamed("pairAddress", "_pool")
    return tips.join(held, F.col("pairAddress").eqNullSafe(F.col("_pool")), "left").select("pairAddress", "tip", zero("pendingBlocks"), zero("pendingEvents"))


def counters(query: StreamingQuery) -> dict[str, int]:
    """Rows that a stream's operators hold, and that they have removed and dropped as late since it was started (as far back as
    Spark keeps progress: spark.sql.streaming.numRecentProgressUpdates)."""
    batches = [[dict(o) if isinstance(o, dict) else o.jsonValue if hasattr(o, "jsonValue") else vars(o) for o in p["stateOperators"]] for p in query.recentProgress]
    total = lambda name: sum(o.get(name, 0) for b in batches for o in b)
    return {"size": sum(o.get("numRowsTotal", 0) for o in batches[-1]) if batches else 0, "removed": total("numRowsRemoved"), "late": total("numRowsDroppedByWatermark")}


#: A round of prices as it is held: its time, its answer and whether it has one.
_ROUND = np.dtype([("at", "<i8"), ("usd", "<f8"), ("known", "?")])
#: Rounds in one piece of state, at most.
_PIECE = 100_000


def _greatest(rounds: np.ndarray) -> np.ndarray:
    """Rounds by time; of those at one time, the greatest answer."""
    rounds = rounds[np.lexsort((rounds["usd"], rounds["known"], rounds["at"]))]
    return rounds[np.append(rounds["at"][1:] != rounds["at"][:-1], True)] if len(rounds) else rounds


class _Prices(StatefulProcessor):
    """State of a token: rounds that may still be asked for (arrays of many), open questions, and the answer given last."""

    def __init__(self, stale: int, remembered: int):
        self.stale, self.remembered = stale, remembered

    def init(self, handle) -> None:
        self.handle = handle
        self.rounds = handle.getListState("rounds", "rows binary")
        self.asked = handle.getListState("asked", "at long")
        self.answered = handle.getValueState("answered", "at long, usd double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked: set[int] = set()
        for frame in rows:
            at, question = frame["at"].to_numpy(np.int64), frame["question"].to_numpy(bool)
            asked.update(at[question].tolist())
            found = np.zeros(np.count_nonzero(~question), _ROUND)
            found["at"], found["known"] = at[~question], frame["known"].to_numpy(bool)[~question]
            found["usd"] = np.where(found["known"], frame["usd"].to_numpy(np.float64)[~question], 0.0)
            if len(found):
                self.rounds.appendValue((_greatest(found).tobytes(),))
        if asked:
            self.asked.appendList([(at,) for at in sorted(asked)])
            self.handle.registerTimer(min(asked) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        asked = sorted({at for (at,) in self.asked.get()})
        due = [at for at in asked if at * 1000 <= now]
        if not due:
            return
        rounds = _greatest(np.concatenate([np.zeros(0, _ROUND), *(np.frombuffer(bytes(rows), _ROUND) for (rows,) in self.rounds.get())]))
        times, out = rounds["at"], []
        last = self.answered.get() if self.answered.exists() else None
        for at, k in zip(due, (np.searchsorted(times, due, "right") - 1).tolist(), strict=True):
            if last is None or at - last[0] >= self.remembered:
                last = (at, float(rounds["usd"][k]) if k >= 0 and rounds["known"][k] and at - int(times[k]) <= self.stale else None)
            out.append(last[1])
        self.answered.update(last)
        rest = [at for at in asked if at * 1000 > now]
        self.asked.put([(at,) for at in rest]) if rest else self.asked.clear()
        if rest:
            self.handle.registerTimer(rest[0] * 1000)
        # Later questions are for later times: of the rounds up to now they need the last one only.
        left = rounds[max(int(np.searchsorted(times, now // 1000, "right")) - 1, 0) :]
        self.rounds.put([(left[k : k + _PIECE].tobytes(),) for k in range(0, len(left), _PIECE)]) if len(left) else self.rounds.clear()
        yield pd.DataFrame({"token": pd.Series([key[0]] * len(due), dtype=object), "at": due, "usd": pd.Series(out, dtype=object)})

    def close(self) -> None:
        pass


def price_stream(asked: DataFrame, rounds: DataFrame, stablecoins: list[str] | None = None, lateness: int = 3600, stale: int = STALE_SECONDS, remembered: int = REMEMBERED_SECONDS) -> DataFrame:
    """token, at and usd for streams of questions (token, at in seconds) and price rounds (token, updatedAt, answer, decimals).

    A question is answered when both streams are `lateness` seconds past its time, so rounds may come in any order within
    that. The answer is the latest round at or before its time, null if that is over `stale` seconds old or there is none,
    1 for stablecoins. For `remembered` seconds after an answer, or a miss, it is given again without another look (0: never).
    Repeated questions for a token and time get one answer; those without a time get none. A token keeps the rounds of the
    lateness and one before, and asks at most once a second, which bounds the state of a hot one.
    """
    asks = asked.select("token", F.col("at").cast("long").alias("at"), F.lit(None).cast("double").alias("usd"), F.lit(False).alias("known"), F.lit(True).alias("question"), F.timestamp_seconds("at").alias("time"))
    usd = F.col("answer").cast("double") / F.pow(F.lit(10.0), "decimals")
    facts = rounds.select("token", F.col("updatedAt").cast("long").alias("at"), usd.alias("usd"), usd.isNotNull().alias("known"), F.lit(False).alias("question"), F.timestamp_seconds("updatedAt").alias("time"))
    late = lambda df: df.withWatermark("time", f"{lateness} seconds").where("at is not null")
    both = late(asks).unionByName(late(facts))
    found = both.groupBy("token").transformWithStateInPandas(_Prices(stale, remembered), "token string, at long, usd double", "Append", "EventTime")
    return found.withColumn("usd", F.when(F.col("token").isin(*stablecoins), 1.0).otherwise(F.col("usd"))) if stablecoins else found
