"""The finality gate deals the blocks of a pool to several keys of state, which all hear of its latest block."""

import pyarrow as pa

from tests.test_engine import events, swap
from tests.test_stream_state import arriving, drained
from tidemark.streaming import jobs, keyed


def test_blocks_of_a_pool_go_to_several_parts():
    schema = pa.schema([("pairAddress", pa.string()), ("eventType", pa.string()), ("blockNumber", pa.int64()), ("seq", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([{"pairAddress": p, "eventType": k, "blockNumber": b, "seq": n} for p, k, b in rows], schema) for n, rows in enumerate([[("a", "Swap", 8), ("a", "Swap", 9), (None, "Mint", None)], [("a", "Swap", 8), ("b", "Flush", None)]])]
    (packed,) = keyed._packed(keyed._gathered(batches))
    rows = [r for b in keyed._dealt([packed], 4) for r in b.to_pylist()]
    assert [(r["pairAddress"], r["block"], r["shard"], r["events"]) for r in rows if r["rows"] is not None] == [("a", 8, 0, 2), ("a", 9, 1, 1), (None, keyed.NEVER, keyed.NEVER % 4, 1)]
    assert [(r["pairAddress"], r["block"], r["flush"], r["shard"]) for r in rows if r["rows"] is None] == [("a", 9, False, k) for k in range(4)] + [("b", keyed.NEVER, True, k) for k in range(4)]


def test_each_part_lets_go_by_the_latest_block_of_the_pool(spark, tmp_path):
    at, out, path = (str(tmp_path / x) for x in "cod")
    parts = [[swap(blockNumber=b) for b in range(100, 120)], [swap(blockNumber=130)], [swap(blockNumber=121)]]
    first = events(spark, *parts[0])
    drained(jobs.start_append(jobs.finality_gate(arriving(spark, path, *[events(spark, *p) for p in parts]), 15, 4), out, at, few=True, availableNow=True))
    assert sorted(r.blockNumber for r in spark.read.schema(first.schema).parquet(out).collect()) == list(range(100, 116))
    assert [tuple(r) for r in keyed.pending(spark, at).collect()] == [("0xPair", 130, 6, 6)]
    shards = keyed._state(spark, at, "tip", 0).select("key.shard", "value.block").collect()
    assert sorted(map(tuple, shards)) == [(k, 130) for k in range(4)]
