"""SimHash near-duplicates by multi-index hashing, and connected components of the links.

Fingerprints are compared once per distinct value, so copies cost nothing. A fingerprint of 64 bits has two segments of
32; of two fingerprints at 3 or fewer differing bits, one segment differs in at most one. Balls of radius 1 around the
segments are enumerated twice:

1. With the other segment as it is. Fingerprints that meet differ in at most two bits, so all that meet at one place
   are linked to the least of them, and a dense cluster of near copies costs as many rows as it has members, not pairs.
2. With the other segment free: every fingerprint is filed under each of its segments and looked up under all 33 values
   of the ball. Only places where fingerprints of different components of step 1 meet are compared, members of a place's
   main component with strangers only, and what is fetched is verified over all 64 bits.

Components follow by hooking and pointer jumping over tables in shared storage; nothing but one sum per round reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, discard, free, grams, joined, materialize, numbered, read, sliced, utf8, word_hashes

SHINGLE, RADIUS, SEED = 3, 3, 42
SEGMENTS, SEGMENT_BITS = 2, 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of all shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - k + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """All columns but text, and fp (a signed long), per row; null texts have no words."""
    names = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            fps = pa.array([fingerprint(t, shingle, seed) for t in utf8(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), fps], [*names, "fp"])

    return docs.select(*names, "text").mapInArrow(run, docs.select(*names).withColumn("fp", F.lit(0).cast("long")).schema)


def segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def ball(fp: Column) -> Column:
    """All values with at most one differing bit in a segment, and none in the other."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])


def close_links(distinct: DataFrame) -> DataFrame:
    """Links a, b that connect just the fingerprints (column fp, distinct) which chains of up to 2 differing bits connect."""
    places = distinct.select("fp", F.explode(ball(F.col("fp"))).alias("place"))
    # Partial aggregates leave one row of a place for each task, however many fingerprints meet there.
    least = places.groupBy("place").agg(F.min("fp").alias("a"), F.max("fp").alias("other")).where("a < other").select("place", "a")
    return joined(least, places, "place").where("fp > a").select("a", F.col("fp").alias("b")).distinct()


def far_links(rooted: DataFrame) -> DataFrame:
    """Links a, b between fingerprints of different roots (columns fp, root) at 3 or fewer differing bits; none is missed."""
    place = lambda k, value: (F.lit(k).cast("long") * (1 << SEGMENT_BITS)).bitwiseOR(value)
    filed = [place(k, segment(F.col("fp"), k)) for k in range(SEGMENTS)]
    near = [place(k, segment(F.col("fp"), k).bitwiseXOR(F.lit(flip))) for k in range(SEGMENTS) for flip in (0, *(1 << i for i in range(SEGMENT_BITS)))]
    table = rooted.select("fp", "root", F.explode(F.array(*filed)).alias("place"))
    probes = rooted.select("fp", "root", F.explode(F.array(*near)).alias("place"))
    occupied = table.groupBy("place").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = materialize(joined(probes, occupied, "place").where((F.col("root") != F.col("low")) | (F.col("root") != F.col("high"))).select("place", "fp", "root"), "met")
    here = met.select("place").distinct()
    table = materialize(joined(table, here, "place", "left_semi"), "filed")
    counts = table.groupBy("place", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("place").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    a = met.select("place", F.col("fp").alias("a"), F.col("root").alias("ra"))
    b = joined(table, main, "place").select("place", F.col("fp").alias("b"), F.col("root").alias("rb"), "main")
    # Strangers meet all members of a place, members of its main component meet strangers only.
    strangers = joined(joined(a, main, "place").where("ra <> main").drop("main"), b.drop("main"), "place")
    members = joined(joined(a, main, "place").where("ra = main").drop("main"), b.where("rb <> main").drop("main"), "place")
    pairs = strangers.unionByName(members).where((F.col("ra") != F.col("rb")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    out = materialize(pairs.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.count("*").alias("n")).select("a", "b"), "far")
    discard(rooted.sparkSession, met, table)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable over edges (a, b), for every node that has an edge.

    Each round, both ends of an edge and their present roots take the least root seen, then every root is replaced by
    its own root. Rounds grow with the logarithm of the longest path. Hot roots meet in joins whose skew Spark splits.
    """
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    before = None
    while True:
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:  # roots only ever decrease
            discard(spark, both)
            return labels
        before = now
        of = lambda end, name: labels.select(F.col("node").alias(end), F.col("root").alias(name))  # noqa: E731, B023
        seen = joined(joined(both, of("b", "rb"), "b").groupBy("a").agg(F.min("rb").alias("rb")), of("a", "ra"), "a")  # the least root next to each node
        told = seen.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("rb").alias("root")), F.struct(F.col("ra").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.*")
        hooked = materialize(told.unionByName(labels).groupBy("node").agg(F.min("root").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = materialize(joined(hooked, up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        discard(spark, labels, hooked)
        labels = after


def stars(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same: each b goes with the least of its partners, and so do these."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    others = joined(links, least, "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("least").alias("a"), "b").unionByName(others).distinct()


def linked(distinct: DataFrame) -> DataFrame:
    """fp, root: the least fingerprint (signed) that links of 3 or fewer differing bits lead to, per distinct fp."""
    spark = distinct.sparkSession
    close = materialize(close_links(distinct), "close")
    labels = components(stars(close))
    rooted = materialize(joined(distinct.select("fp"), labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
    discard(spark, close, labels)
    far = far_links(rooted)
    above = components(stars(far)).select(F.col("node").alias("root"), F.col("root").alias("above"))
    return materialize(joined(rooted, above, "root", "left").select("fp", F.coalesce("above", "root").alias("root")), "linked")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable) per row of docs.

    Null and empty texts have the fingerprint zero, and are linked like any other. Repeated rows and doc_ids come out
    once each; null ids never name a component, unless all ids in it are null. Empty tables give no rows. Texts of any
    length are hashed whole; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    prints = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = linked(classes)
    rooted = joined(classes, roots, "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(joined(rooted, named, "root").select("fp", "component_id"), "named")
    discard(spark, classes, roots)
    return joined(prints, table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For whole-document similarity: words of a shingle, and the least share (of 10) of all shingles of two rows that both have.
WORDS, ALIKE = 5, 8
#: Shingles in at least OFTEN of every SAMPLE-th row come last in the order of shingles; the OFTEN_MOST most frequent of
#: them at most. These numbers decide how much is compared, never what is found.
SAMPLE, OFTEN, OFTEN_MOST = 12, 3, 500_000
#: Powers of two: parts of the range of hashes whose counts bound how much two sets can share, for short and for long sets.
FEW_PARTS, MANY_PARTS = 7, 12
#: Row numbers (eight bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Places that one task step looks through, about.
PART = 250_000
#: Texts that a task remembers to leave copies out; beyond that it begins anew.
REMEMBERED = 500_000


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted, different hashes of the five-word shingles of a text (of all its words if they are fewer)."""
    x = word_hashes((text or b"").lower().split())
    return np.unique((grams(x, min(WORDS, len(x))) if len(x) else x).view(np.int64))


def alike(x: Column, y: Column) -> Column:
    """Whether two sets share ALIKE tenths of their union or more."""
    shared = F.size(F.array_intersect(x, y))
    return shared * (10 + ALIKE) >= (F.size(x) + F.size(y)) * ALIKE


def counters(s: np.ndarray) -> bytes | None:
    """How many hashes lie in each part of their range, with two hashes to a part or so; None if a count needs more than a byte."""
    bits = min(MANY_PARTS, max(FEW_PARTS, (len(s) // 2).bit_length()))
    counts = np.bincount((s.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def most_shared(a: bytes | None, b: bytes | None) -> int:
    """A bound on the hashes that two sets share, by their counts."""
    if a is None or b is None:
        return 1 << 60
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):  # the parts of one are halves (or less) of the other's
        few = min(len(x), len(y))
        x, y = x.reshape(few, -1).sum(1, dtype=np.int64), y.reshape(few, -1).sum(1, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def can_be_alike(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs a, b without those that cannot be alike: two sets share at most the lesser count of each part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb, na, nb = (batch.column(c).to_pylist() for c in ("ca", "cb", "na", "nb"))
            can = [most_shared(x, y) * (10 + ALIKE) >= (m + n) * ALIKE for x, y, m, n in zip(ca, cb, na, nb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(can, pa.bool_()))

    of = lambda end: prints.select(F.col("_row").alias(end), F.col("counters").alias(f"c{end}"), F.col("size").alias(f"n{end}"))
    return joined(joined(pairs.select("a", "b"), of("a"), "a"), of("b"), "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs a, b of rows of docs (column _row) whose sets of shingles are alike; only rows of pairs are fetched."""
    pairs = materialize(can_be_alike(pairs, prints), "pairs")
    wanted = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([shingles(t) for t in utf8(batch, "text")], pa.list_(pa.int64()))], ["_row", "s"])

    # Few rows are wanted as a rule; their numbers then go to the texts. Where they are many, both are shuffled.
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = docs.select("_row", "text").join(F.broadcast(wanted) if few else wanted, "_row", "left_semi")
    sets = materialize(some.mapInArrow(cut, "_row long, s array<long>"), "sets")

    of = lambda end: sets.select(F.col("_row").alias(end), F.col("s").alias(f"s{end}"))
    out = materialize(joined(joined(pairs, of("a"), "a"), of("b"), "b").where(alike(F.col("sa"), F.col("sb"))).select("a", "b"), "links")
    discard(docs.sparkSession, sets, pairs)
    return out


def frequent(docs: DataFrame) -> np.ndarray:
    """Frequent shingles of a share of docs, rarest first; their number is bounded."""
    some = docs.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [shingles(t) for t in utf8(batch, "text")]
            place, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(times)], ["place", "n"])

    counts = some.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "place").limit(OFTEN_MOST).toArrow()
    return rows.column("place").to_numpy()[::-1].copy()


def similar_groups(docs: DataFrame) -> DataFrame:
    """id, root of groups of rows (column _row) that are linked: rows with the same set of shingles are one id, the least.

    A link is a pair whose exact similarity is 0.8 or more. Pairs to compare come from SimHash (each row with the least of its
    component), and, as that misses many at this similarity, from a prefix filter too, which misses none:
    of two alike sets of x and y shingles in one common order, the first shared one has at least 0.8 / 1.8 * (x + y) shared
    ones from it on, so it is among the first fifth of both. Frequent shingles come last in the order, so that common
    lines and templates bring nothing together that its other words keep apart.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingles(t) for t in utf8(batch, "text")]
            columns = [batch.column("_row"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(counters, sets), pa.binary())]
            columns.append(pa.array([fingerprint(t) for t in utf8(batch, "text")], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["_row", "digest", "size", "counters", "fp"])

    prints = materialize(docs.select("_row", "text").mapInArrow(run, "_row long, digest binary, size long, counters binary, fp long"), "prints")
    sized = materialize(prints.groupBy("digest").agg(F.min("_row").alias("id"), F.min("size").alias("size"), F.min_by("fp", "_row").alias("fp")).select("id", "size", "fp"), "classes")
    classes = sized.select("id")
    met = joined(meetings(docs, sized.agg(F.sum("size")).first()[0] or 0), classes, "id", "left_semi")
    met = materialize(met, "met")
    least = met.groupBy("place").agg(F.min(F.struct("id", "size", "at")).alias("rep"), F.count("*").alias("n")).where("n > 1").select("place", "rep")
    votes = joined(met, least, "place").where((F.col("rep.id") < F.col("id")) & possible("size", "at", "rep.size", "rep.at")).groupBy("id", F.col("rep.id").alias("rep")).agg(F.count("*").alias("n"))
    # One comparison for each row to begin with: the least of those that it meets at half as many places as any or more.
    votes = materialize(votes, "votes")
    most = votes.groupBy("id").agg(F.max("n").alias("most"))
    first = joined(votes, most, "id").where("2 * n >= most").groupBy("id").agg(F.min("rep").alias("rep"))
    first = first.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    near = verified(first.unionByName(simhash_pairs(sized)).distinct(), docs, prints)
    discard(spark, votes)
    groups = rooted(classes, near)
    pairs, mixed = apart(met, groups)
    more = verified(pairs, docs, prints)
    discard(spark, prints, met, groups, *mixed)
    out = rooted(classes, near.unionByName(more))
    discard(spark, sized, near, more)
    return out


def simhash_pairs(sized: DataFrame) -> DataFrame:
    """Pairs a, b of ids (columns id, fp) whose fingerprints links of 3 or fewer differing bits connect: each id with the least of its component."""
    classes = materialize(sized.select("fp").distinct(), "fingerprints")
    roots = linked(classes)
    of = joined(sized.select("id", "fp"), roots, "fp")
    least = of.groupBy("root").agg(F.min("id").alias("b"))
    out = materialize(joined(of, least, "root").where("id > b").select(F.col("id").alias("a"), "b"), "alike")
    discard(sized.sparkSession, classes, roots)
    return out


def meetings(docs: DataFrame, total: int) -> DataFrame:
    """id, size, at, place: the first shingles of rows of docs that other rows have among their first ones too.

    Of rows with one set of shingles, a task sends the least alone (and those that it met before it), so that a text with very
    many copies does not fill its places; the least of all rows is always sent. Places go to the tasks in blocks of bytes,
    cut by their hashes; total is the number of all shingles, copies apart.
    """
    spark = docs.sparkSession
    often = frequent(docs)
    order = np.argsort(often, kind="stable")
    held = spark.sparkContext.broadcast((often[order], order))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * (10 - ALIKE) // 10 // PART)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = held.value
        least: dict[bytes, int] = {}
        for batch in sliced(batches, "text"):
            firsts, sizes, sent = [], [], []
            for row, text in zip(batch.column("_row").to_pylist(), utf8(batch, "text"), strict=True):
                s = shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if least.get(digest, row + 1) <= row:
                    continue
                if len(least) >= REMEMBERED:
                    least.clear()
                least[digest] = row
                sent.append(row)
                sizes.append(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, ranks[at], -1), kind="stable")]
                firsts.append(s[: len(s) - -(-ALIKE * len(s) // 10) + 1])
            rows = np.array(sent, np.int64)
            for high in np.unique(rows >> 32).tolist():  # rows of several files may come in one batch
                mine = np.flatnonzero(rows >> 32 == high)
                own, n = [firsts[k] for k in mine], np.array([len(firsts[k]) for k in mine])
                place = np.concatenate(own)
                at = np.concatenate([np.arange(k, dtype="<u4") for k in n])
                base = high << 32
                who, size = np.repeat((rows[mine] - base).astype("<u4"), n), np.repeat(np.array(sizes, "<u4")[mine], n)
                part = (place.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                ids, begin = np.unique(part[by], return_index=True)
                ends = [*begin[1:].tolist(), len(by)]
                pick = lambda x: pa.array([x[by[a:b]].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([base] * len(ids), pa.int64()), *map(pick, (place, who, size, at))], ["part", "base", "place", "who", "size", "at"])

    def meet(table: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        place = whole("place", "<i8")
        n = [len(x) // 8 for x in table.column("place").to_pylist()]
        row = whole("who", "<u4").astype("<i8") + np.repeat(table.column("base").to_numpy(), n)
        _, which, times = np.unique(place, return_inverse=True, return_counts=True)
        some = times[which] > 1
        return pa.table([pa.array(x[some].astype("<i8")) for x in (row, whole("size", "<u4"), whole("at", "<u4"), place)], ["id", "size", "at", "place"])

    blocks = docs.select("_row", "text").mapInArrow(cut, "part long, base long, place binary, who binary, size binary, at binary")
    return blocks.groupBy("part").applyInArrow(meet, "id long, size long, at long, place long")


def possible(size_x: str, at_x: str, size_y: str, at_y: str) -> Column:
    """Whether sets that share a place at these positions can be alike, if it is the first place that they share."""
    sx, ax, sy, ay = map(F.col, (size_x, at_x, size_y, at_y))
    return (F.least(sx - ax, sy - ay) * (10 + ALIKE) >= (sx + sy) * ALIKE) & (F.least(sx, sy) * 10 >= F.greatest(sx, sy) * ALIKE)


def apart(met: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs a < b of ids that share a place, can be alike by their sizes and positions, and are in different groups; and the tables stored for them.

    Of each place, the rows outside its largest group meet all rows of other groups; the rows of that group do not meet
    each other, so a large group of copies brings as many pairs as there are strangers among it.
    """
    rows = joined(met, groups, "id")
    different = rows.groupBy("place").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("place")
    mixed = materialize(joined(rows, different, "place"), "mixed")
    counts = mixed.groupBy("place", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("place").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    rows = joined(mixed, main, "place")
    x, y = (rows.select("place", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "size", "at", "root", "main")]) for end in "xy")
    minor = x.where("root_x <> main_x")
    can = possible("size_x", "at_x", "size_y", "at_y")
    once = (F.col("root_y") == F.col("main_y")) | (F.col("id_x") < F.col("id_y"))
    pairs = joined(minor, y, "place").where((F.col("root_x") != F.col("root_y")) & once & can)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), [mixed]


def rooted(classes: DataFrame, near: DataFrame) -> DataFrame:
    """id, root: the least id that links a, b lead to, for every id of classes."""
    labels = components(stars(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    out = materialize(joined(classes, labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "rooted")
    discard(classes.sparkSession, labels)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that an earlier row of their group stands for; columns stay as they are.

    Groups are those of similar_groups: five-word shingles, a similarity of 0.8 or more. Rows are told apart by a number
    of their own, so null and repeated doc_ids do no harm; of repeated rows, and of texts without words (null, empty),
    one stays. Long texts are compared whole. Columns may have any names. Empty tables give no rows.
    """
    (row,) = free(docs.columns, "row")
    rows = numbered(docs, row)
    groups = similar_groups(rows.select(F.col(row).alias("_row"), F.col("text").cast("string").alias("text")))
    stay = groups.where(F.col("id") == F.col("root")).select(F.col("id").alias(row))
    # The numbers go to the texts while they are few; beyond that both are shuffled.
    few = stay.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(stay) if few else stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
