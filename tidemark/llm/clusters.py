"""Centroid clustering: Lloyd's rounds in which a tree of vectors is compared with a tree of centroids.

Vectors are dealt to blocks; each block is put into a cover tree once and stored. A round sends the few centroids to all
blocks, puts them into a cover tree too, and goes down both trees at once: a pair of nodes goes when bounds on their
distance show that none of its vectors has its nearest centroid there; vectors of a leaf are compared with the centroids
left to it exactly. A block answers with sums and counts per centroid, which Spark adds. All numbers are integers, so the
result does not depend on how vectors are dealt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, discard, materialize, read

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors of one block (its tree is one row of the stored table), and vectors that a node is not split below.
BLOCK, LEAF = 1024, 16
#: Factor between the radii of two levels of a tree.
BASE = 1.5
#: Components are held to this range, as a squared distance between larger ones does not fit into a long.
MOST = 1 << 27
#: Up to here, sums of products of 64 components are exact as floating point numbers.
NARROW = 1 << 22
#: Bytes that differences of wide vectors take at a time.
WIDE_BYTES = 32 << 20
LONG = (1 << 63) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of a and of b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if max(np.abs(a).max(), np.abs(b).max()) * max(1, a.shape[1] // SIZE) <= NARROW:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.rint((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, WIDE_BYTES // (8 * b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :].astype(np.int64) - b[None, :, :].astype(np.int64)
        out[at : at + step] = (d * d).sum(2)
    return out


class Tree(NamedTuple):
    """A cover tree. Its vectors stand so that each node has a stretch of them, the node's own centre first.

    Children of a node are distinct vectors of its stretch, farther from each other than the radius of their level; each
    vector is within that radius of the child that holds it. A node's first child has the node's centre.
    """

    order: np.ndarray  # places of the vectors in the given table
    begin: np.ndarray  # by node
    end: np.ndarray
    radius: np.ndarray  # squared distance of the farthest vector of the node from its centre
    child: np.ndarray  # first child, children stand together; -1: a leaf
    children: np.ndarray


def cover_tree(vectors: np.ndarray, leaf: int = LEAF, base: float = BASE) -> Tree:
    """The tree of a table of integers; a node of at most `leaf` vectors or of equal ones is a leaf."""
    order = np.arange(len(vectors))
    begin, end, radius, child, children = [0], [len(vectors)], [0], [-1], [0]
    if len(vectors):
        radius[0] = int(squared(vectors, vectors[:1]).max())
    node = 0
    while node < len(begin):
        b, e, r = begin[node], end[node], radius[node]
        if e - b > leaf and r > 0:
            level = np.ceil(np.log(np.sqrt(r)) / np.log(base) - 1e-9)
            near = int(min(base ** (2 * (level - 1)), r - 1))  # less than r: at least one vector gets a child of its own
            left, at = order[b:e].copy(), b
            child[node] = len(begin)
            while len(left):
                d = squared(vectors[left], vectors[left[:1]])[:, 0]
                inside = d <= near
                own = left[inside]
                order[at : at + len(own)] = own
                begin.append(at)
                at += len(own)
                end.append(at)
                radius.append(int(d[inside].max()))
                child.append(-1)
                children.append(0)
                left = left[~inside]
            children[node] = len(begin) - child[node]
        node += 1
    return Tree(order, *(np.array(x, np.int64) for x in (begin, end, radius, child, children)))


def nearest(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, of: Tree, whole, some) -> None:
    """Finds the nearest centroid of each vector, ties by the smaller number.

    vectors: in the order of their tree; of: the tree of centroids with leaves of one. whole(begin, end, number) gets
    stretches that belong to one centroid; some(places, numbers, distances) gets vectors that were compared one by one.
    """
    if not len(vectors) or not len(centroids):
        return
    centres = centroids[of.order[of.begin]]
    spread = np.sqrt(of.radius)
    alone = of.child < 0
    nodes = np.array([0])
    pairs = np.zeros((1, len(of.begin)), bool)  # by node of the vectors: nodes of the centroids that may be nearest
    pairs[0, 0] = True
    while len(nodes):
        d = np.sqrt(squared(vectors[tree.begin[nodes]], centres))
        reach = np.sqrt(tree.radius[nodes])[:, None]
        bound = np.where(pairs, d + reach, np.inf).min(1, keepdims=True)
        pairs &= (d - reach - spread) * (1 - 1e-9) <= bound * (1 + 1e-9) + 1e-6
        # One level down among the centroids.
        inner = np.flatnonzero(pairs.any(0) & ~alone)
        for k in inner:
            pairs[:, of.child[k] : of.child[k] + of.children[k]] |= pairs[:, k : k + 1]
            pairs[:, k] = False
        split = pairs[:, inner].any(1) if len(inner) else np.zeros(len(nodes), bool)
        again = pairs[:, ~alone].any(1) | split
        single = ~again & (pairs.sum(1) == 1)
        for i in np.flatnonzero(single):
            whole(int(tree.begin[nodes[i]]), int(tree.end[nodes[i]]), int(of.order[of.begin[pairs[i].argmax()]]))
        leaf = tree.child[nodes] < 0
        for i in np.flatnonzero(~single & ~again & leaf):
            places = np.arange(tree.begin[nodes[i]], tree.end[nodes[i]])
            numbers = np.sort(of.order[of.begin[pairs[i]]])
            exact = squared(vectors[places], centroids[numbers])
            best = exact.argmin(1)
            some(places, numbers[best], exact[np.arange(len(places)), best])
        down = np.flatnonzero(~single & ~leaf)
        stay = np.flatnonzero(~single & leaf & again)
        below = [np.arange(tree.child[nodes[i]], tree.child[nodes[i]] + tree.children[nodes[i]]) for i in down]
        pairs = np.concatenate([pairs[stay], np.repeat(pairs[down], [len(x) for x in below], 0)])
        nodes = np.concatenate([nodes[stay], *below]).astype(np.int64)


def sums_of(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, of: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the vectors nearest to each centroid."""
    sums, counts = np.zeros((len(centroids), vectors.shape[1]), np.int64), np.zeros(len(centroids), np.int64)
    before = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(vectors, 0, dtype=np.int64)])

    def whole(begin: int, end: int, number: int) -> None:
        sums[number] += before[end] - before[begin]
        counts[number] += end - begin

    def some(places: np.ndarray, numbers: np.ndarray, _: np.ndarray) -> None:
        for c in np.unique(numbers):
            sums[c] += vectors[places[numbers == c]].sum(0, dtype=np.int64)
        np.add.at(counts, numbers, 1)

    nearest(vectors, tree, centroids, of, whole, some)
    return sums, counts


def assigned(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, of: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector."""
    number, distance = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)

    def whole(begin: int, end: int, c: int) -> None:
        number[begin:end] = c
        distance[begin:end] = squared(vectors[begin:end], centroids[c : c + 1])[:, 0]

    def some(places: np.ndarray, numbers: np.ndarray, exact: np.ndarray) -> None:
        number[places], distance[places] = numbers, exact

    nearest(vectors, tree, centroids, of, whole, some)
    return number, distance


def integers(embedding: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless there are exactly `size` finite ones."""
    at = F.transform(embedding, lambda x: x.cast("double"))
    fit = (F.size(embedding) == size) & ~F.exists(at, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(at, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return F.when(F.coalesce(fit, F.lit(False)), held)


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least hashes, by hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where(F.col("vec_id").isNotNull()).select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # `clusters` rows
    return np.array([r["v"] for r in rows], np.int64)


TREES = "ids array<long>, vectors binary, nodes binary"


def trees(kept: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """Cover trees over blocks of vectors: a row each, with the ids and vectors in the tree's order."""

    def grown(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(vectors)
        tree = cover_tree(v)
        named = pa.concat_arrays(ids).take(pa.array(tree.order))
        nodes = np.stack(tree[1:]).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(named)], named), pa.array([v[tree.order].astype("<i4").tobytes()], pa.binary()), pa.array([nodes], pa.binary())], ["ids", "vectors", "nodes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            named, flat = batch.column("vec_id"), batch.column("v").flatten().to_numpy().reshape(-1, size)
            at = 0
            while at < len(flat):
                to = min(len(flat), at + block - held)
                ids.append(named.slice(at, to - at))
                vectors.append(flat[at:to].astype(np.int64))
                held, at = held + to - at, to
                if held == block:
                    yield grown(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield grown(ids, vectors)

    return kept.select("vec_id", "v").mapInArrow(run, TREES)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, Tree, pa.Array]]:
    for k in range(batch.num_rows):
        vectors = np.frombuffer(batch.column("vectors")[k].as_py(), "<i4").reshape(-1, size).astype(np.int64)
        parts = np.frombuffer(batch.column("nodes")[k].as_py(), "<i8").reshape(5, -1)
        yield vectors, Tree(np.arange(len(vectors)), *parts), batch.column("ids")[k].values


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per vector of rows that counts.

    A row counts if its embedding has exactly `size` components, none null or non-finite; others give no row. Each counts
    by itself, whatever it repeats: repeated vec_ids tie as first centroids and fall by their vectors, null ids come out
    but are no first centroids. With fewer vectors than clusters there are as many centroids as vectors with an id; with
    none, and for an empty table, there are no rows. Components beyond 2^27 after scaling count as 2^27; sums of distances
    end at the largest long. Other columns are not read.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), size, scale).alias("v")).where(F.col("v").isNotNull())
    centroids = first_centroids(kept, clusters, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    table = materialize(trees(kept, size), "trees", **{"parquet.block.size": 16 << 20})  # a reader may hold a whole row group

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(centroids)  # `clusters` vectors

        def gather(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            of = cover_tree(now.value, leaf=1)
            sums, counts = np.zeros(now.value.shape, np.int64), np.zeros(len(now.value), np.int64)  # of a task's vectors
            for batch in batches:
                for vectors, tree, _ in _blocks(batch, size):
                    s, n = sums_of(vectors, tree, now.value, of)
                    sums += s
                    counts += n
            which, part = np.repeat(np.arange(len(counts), dtype=np.int32), size), np.tile(np.arange(size, dtype=np.int32), len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(part), pa.array(sums.ravel()), pa.array(np.repeat(counts, size))], ["cluster", "part", "s", "n"])

        parts = table.select("vectors", "nodes", F.lit(None).cast("array<long>").alias("ids")).mapInArrow(gather, "cluster int, part int, s long, n long")
        totals = parts.groupBy("cluster", "part").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).where("n > 0").collect()  # `clusters` times `size` rows
        centroids = centroids.copy()
        for r in totals:
            centroids[r["cluster"], r["part"]] = int(r["s"]) // r["n"]

    final = spark.sparkContext.broadcast(centroids)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = cover_tree(final.value, leaf=1)
        for batch in batches:
            for vectors, tree, ids in _blocks(batch, size):
                number, distance = assigned(vectors, tree, final.value, of)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    labelled = materialize(table.mapInArrow(label, schema), "labelled")
    discard(spark, table)
    inertia = {r["cluster"]: int(r["s"]) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # `clusters` rows
    by_cluster = [(k, min(inertia.get(k, 0), LONG), sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    known = spark.createDataFrame(by_cluster, "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia")
    return labelled.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")  # `clusters` rows


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Lloyd's rounds as plain SQL: each is a join of all components with those of all centroids."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "comps AS MATERIALIZED (SELECT row, unnest(generate_series(1, 64)) AS j, unnest(v) AS x FROM kept)",
        """c0 AS MATERIALIZED (SELECT c, unnest(generate_series(1, 64)) AS j, unnest(v) AS x FROM (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)))""",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT l.row, c.c, CAST(sum((l.x - c.x) * (l.x - c.x)) AS BIGINT) AS d FROM comps l JOIN c{k} c ON l.j = c.j GROUP BY ALL) GROUP BY row)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN (
  SELECT a.best.c AS c, l.j AS j, CAST((sum(l.x) - ((sum(l.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM a{k} a JOIN comps l ON a.row = l.row GROUP BY ALL) m ON o.c = m.c AND o.j = m.j)""")
    last = ROUNDS
    return f"""WITH {", ".join(parts)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT k.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM kept k JOIN a{last} a ON k.row = a.row JOIN digest g ON g.c = a.best.c"""


OP11_SQL = _sql()
