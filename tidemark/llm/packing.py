"""Best-fit packing of documents into sequences by bin completion with branch and bound.

Only the histogram of piece lengths (at most one count for each length up to the capacity) reaches the driver, so the
search costs the same for any number of documents. It fills the sequence of the largest piece left with each undominated
completion in turn, for as many sequences as its lengths last and then for fewer, prunes by the waste that the best known
packing still allows, and starts from best fit. The one limit is the number of search steps (`nodes`, None for none): where
the search ends by itself the packing has the least number of sequences, else it is the best found, never worse than best
fit. A plan that repeats fillings as long as they last has at most `capacity` fillings of at most 63 different lengths each
(1 + 2 + ... + 63 = 2016); fewer repeats add at most one filling for each step of the search, so its size is bounded.

Pieces are then numbered within their length, in salted groups, and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, materialize, read, sliced
from tidemark.llm.tokens import default_vocabulary, encoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Steps that the search may take; the best packing found by then is used.
NODES = 200_000
#: Pieces of one length are numbered in groups of about this many, or the root of their number if that is more.
GROUP = 500

#: The id that ends a document.
CLOSE = b"\0\0\0\0"

Filling = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in one sequence), ...), sequences


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece: the ids and a closing 0, cut only when longer than capacity; the first piece takes the odd rest."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path)
        for batch in sliced(batches, "text", keep=True):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), held.ids(texts), strict=True):
                raw = ids + CLOSE
                n, at, k = len(raw) // 4, 0, 0
                view = memoryview(raw)
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(view[4 * at : 4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Around the largest length left, always the largest that still fits; the incumbent of the search."""
    left, plan = dict(counts), []
    while left:
        order = sorted(left, reverse=True)
        room, chosen = capacity, []
        for x in order:
            n = min(room // x, left[x])
            if n:
                chosen += [x] * n
                room -= n * x
            if not room:
                break
        plan.append(_take(left, tuple(chosen)))
    return plan


def _take(left: dict[int, int], lengths: Iterable[int], most: int | None = None) -> Filling:
    """Takes the filling of one sequence with these lengths out of left, for as many sequences as they last, or at most `most`."""
    uses: dict[int, int] = {}
    for x in lengths:
        uses[x] = uses.get(x, 0) + 1
    times = min(left[x] // n for x, n in uses.items())
    times = times if most is None else min(times, most)
    for x, n in uses.items():
        left[x] -= n * times
        if not left[x]:
            del left[x]
    return tuple(sorted(uses.items(), reverse=True)), times


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces that cannot share one (for each threshold k: those over capacity - k stand alone, those over half need one each, what the others of at least k need beyond the room beside these)."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in {x for x in counts if 2 * x <= capacity}:
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        large = sum(n for x, n in counts.items() if capacity - k >= x > capacity / 2)
        room = sum(n * (capacity - x) for x, n in counts.items() if capacity - k >= x > capacity / 2)
        small = sum(n * x for x, n in counts.items() if capacity / 2 >= x >= k)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return max(best, sum(n for x, n in counts.items() if 2 * x > capacity))


class Steps:
    """The steps that a search may still take."""

    def __init__(self, most: int | None):
        self.left = most

    def spent(self) -> bool:
        if self.left is None:
            return False
        self.left -= 1
        return self.left < 0


def completions(left: dict[int, int], capacity: int, allowed: int, steps: Steps, after: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
    """Undominated fillings around the largest length left with at most `allowed` waste, those with large lengths first.

    A length that closes a gap exactly dominates all else that could go into it. A filling is also dominated if something
    left still fits, or if a length of it can be exchanged for a larger one that is left and fits. With after (an earlier
    filling around the same length, whose repeats have been chosen) only fillings that come later in this order follow.
    left must be the same whenever the next filling is asked for.
    """
    order = sorted(left, reverse=True)
    top = order[0]
    negative = [-x for x in order]

    def spare(x: int, chosen: tuple[int, ...]) -> int:
        return left[x] - chosen.count(x)

    def later(chosen: tuple[int, ...]) -> bool:
        return not after or chosen < after

    def extend(at: int, gap: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if steps.spent():
            return
        if not gap:
            if later(chosen):
                yield chosen
            return
        if gap in left and spare(gap, chosen) > 0:
            if gap < chosen[-1] and later((*chosen, gap)):
                yield (*chosen, gap)
            if gap <= chosen[-1]:
                return
        for k in range(max(at, bisect_left(negative, -gap)), len(order)):
            x = order[k]
            for n in range(min(gap // x, spare(x, chosen)), 0, -1):
                yield from extend(k + 1, gap - n * x, (*chosen, *[x] * n))
                if steps.left is not None and steps.left < 0:
                    return
        if gap <= allowed and later(chosen):
            fits = any(spare(x, chosen) > 0 for x in order[bisect_left(negative, -gap) :])
            better = any(spare(x, chosen) > 0 for y in set(chosen[1:]) for x in order[bisect_left(negative, -y - gap) : bisect_left(negative, -y)])
            if not fits and not better:
                yield chosen

    for n in range(min(capacity // top, left[top]), 0, -1):
        yield from extend(1, capacity - n * top, (top,) * n)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[Filling]:
    """A packing in as few sequences as the search finds; the least number where it ends within `nodes` steps or meets the lower bound."""
    total = sum(x * n for x, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    left, plan = dict(counts), []
    used = wasted = 0
    steps = Steps(nodes)
    last: tuple[int, ...] = ()  # the filling before, if it stands around the same length
    frames: list[tuple[Iterator[tuple[int, ...]], list]] = []  # at each depth: fillings still to come, and [the one in use, its repeats]

    def allowed() -> int:
        return (best_n - 1) * capacity - total - wasted  # more waste cannot beat the best

    def use(lengths: tuple[int, ...], most: int | None) -> int:
        nonlocal used, wasted
        waste = capacity - sum(lengths)
        if waste:
            most = min(allowed() // waste, most if most is not None else allowed() // waste)
        filling = _take(left, lengths, most)
        plan.append(filling)
        used += filling[1]
        wasted += waste * filling[1]
        return filling[1]

    def undo() -> None:
        nonlocal used, wasted
        filling = plan.pop()
        for x, n in filling[0]:
            left[x] = left.get(x, 0) + n * filling[1]
        used -= filling[1]
        wasted -= (capacity - sum(x * n for x, n in filling[0])) * filling[1]

    def open_frame() -> None:
        nonlocal best, best_n
        if not left:
            if used < best_n:
                best, best_n = list(plan), used
            frames.append((iter(()), []))
        else:
            top = max(left)
            frames.append((completions(left, capacity, min(allowed(), capacity - top), steps, last if last and last[0] == top else ()), []))

    open_frame()
    while frames and best_n > bound and (steps.left is None or steps.left >= 0):
        fillings, current = frames[-1]
        if current:
            undo()
            # A single length that closes the gap exactly is no worse than anything else, however often it is used.
            if current[1] > 1 and (len(current[0]) > 2 or sum(current[0]) < capacity) and allowed() >= 0:
                current[1] -= 1
                use(*current)
                last = current[0]
                open_frame()
                continue
            current.clear()
        lengths = next(fillings, None) if allowed() >= 0 else None
        if lengths is None:
            frames.pop()
            continue
        if capacity - sum(lengths) > allowed():  # the bound has come down since
            continue
        current += [lengths, use(lengths, None)]
        last = lengths
        open_frame()
    return best


def _places(plan: list[Filling]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, how many in one sequence, first sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, times in plan:
        offset = 0
        for x, n in lengths:
            out.setdefault(x, []).append((taken.get(x, 0), n, base, offset))
            taken[x] = taken.get(x, 0) + n * times
            offset += n * x
        base += times
    return {x: np.array(rows, "<i8") for x, rows in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, nodes: int | None = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Null and empty texts are the closing 0 alone. Repeated rows and doc_ids, null ids included, are packed once each.
    An empty table gives no rows. Other columns are not read. Ties between equal lengths fall by the pieces' own order.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    table = materialize(pieces(docs, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(_places(bin_completion(histogram, capacity, nodes)))
    # Many pieces may share a length (full ones, empty texts): number them in even groups, then add the groups before.
    groups = spark.createDataFrame([(x, -(-n // max(GROUP, isqrt(n)))) for x, n in histogram.items()], "length long, groups long")
    mixed = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    salted = materialize(table.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(mixed, F.col("groups"))).drop("groups"), "salted")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "salt"]).withColumn("_rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), "<i8"), np.zeros(len(length), "<i8")
            for x in np.unique(length).tolist():
                at = length == x
                rows = plan.value[x]
                run = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                since = rank[at] - run[:, 0]
                sequence[at] = run[:, 2] + since // run[:, 1]
                offset[at] = run[:, 3] + since % run[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return placed.select(*names, F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
