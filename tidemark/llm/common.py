"""Helpers that the text operators share: shared storage for cut lineage, row numbers, word hashes, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python in one go are cut to batches of at most this many bytes of text.
SLICE_BYTES = 4 << 20
#: Rows handed to Python in one go by Spark: batches of at most this many bytes.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Files of a table whose rows are numbered in place at most; rows of more files are numbered in a stored copy.
MAX_FILES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A temporary one is set only where none is and all tasks
    run in this process, as in tests; on a cluster the setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.TemporaryDirectory(prefix="tidemark-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        base = f"file://{folder.name}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base


#: Paths of tables that are stored and not yet discarded, oldest first.
_stored: dict[str, None] = {}


def materialize(df: DataFrame, tag: str, schema: str | None = None, **options: int) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so that a lost executor costs no recomputation.

    options: of the Parquet writer, besides its compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)  # texts take about two thirds of the space of Spark's default
    _stored[path] = None
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._stored_at = path
    return out


def stored() -> set[str]:
    """Paths of the tables stored so far."""
    return set(_stored)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_stored_at", None)
        if path in _stored:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            del _stored[path]


@atexit.register
def _discard_all() -> None:
    with suppress(Exception):  # the session may have ended before; then the folder's owner clears it
        discard(SparkSession.getActiveSession(), *_stored)


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An equi-join that shuffles both sides, whatever their size is thought to be.

    Spark takes what explode makes for no larger than what it is made of, and a stored table for as large as its compressed
    file. A table that grows with the corpus would so pass for small, and be gathered by the driver to be broadcast.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Names that no column has, whatever its case: the given ones with as many underscores before them as it takes."""
    used = {t.casefold() for t in taken}
    out = []
    for name in names:
        while name.casefold() in used:
            name = f"_{name}"
        used.add(name.casefold())
        out.append(name)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether df is rows of files as they are: filters and projections of one scan, without random parts."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        if not plan.deterministic():
            return False
        kind = plan.getClass().getSimpleName()
        if kind == "LogicalRelation":
            return True
        if kind not in ("Project", "Filter", "SubqueryAlias") or plan.children().size() != 1:
            return False
        plan = plan.children().head()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row (a long named name) that is the same whenever and wherever the row is read.

    Rows of files are numbered by file and place in the file. Anything else is numbered once in a stored copy, as numbers
    given on the fly change with the way a scan is dealt to executors.
    """
    spark = df.sparkSession
    if "_metadata" not in {c.casefold() for c in df.columns} and _is_scan(df):
        path, index, file = free([*df.columns, name], "path", "index", "file")
        with suppress(AnalysisException):
            files = df.select(F.col("_metadata.file_path").alias("path")).distinct().limit(MAX_FILES + 1).collect()
            if len(files) <= MAX_FILES:
                places = spark.createDataFrame([(r["path"], k) for k, r in enumerate(sorted(files))], f"`{path}` string, `{file}` long")
                there = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
                row = F.shiftleft(F.col(file), 40).bitwiseOR(F.col(index)).alias(name)
                return there.join(F.broadcast(places), path).select(*[F.col(f"`{c}`") for c in df.columns], row)  # MAX_FILES rows
    return materialize(df.select("*", F.monotonically_increasing_id().alias(name)), "numbered")


def let(value: Column, body) -> Column:
    """Evaluates value once and binds it for body; a plain column reference may be inlined into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay, unlike with lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Hands memory that a worker no longer uses back to the system; idle workers share it with the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lets batches of at most BATCH_BYTES go to Python workers, as both sides hold each several times; a limit that the session
    sets itself stays. The size of a batch never changes a result."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


_per_worker: list = []


def per_worker(make: Callable) -> Callable:
    """Lets a worker make something once and use it in all tasks, until it goes on to an operator that has no need of it."""
    held = lru_cache(maxsize=2)(make)
    _per_worker.append(held)
    return held


def sliced(batches: Iterable[pa.RecordBatch], text: str, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds more than SLICE_BYTES of text (a single longer text stays whole).

    Workers live on between operators; unless keep is set, what one holds by per_worker is given up first.
    """
    if not keep:
        for held in _per_worker:
            held.cache_clear()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * SLICE_BYTES / max(batch.column(text).nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    give_back()


def utf8(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    return batch.column(text).cast(pa.binary()).to_pylist()


#: Bytes that words are hashed in at a time; longer words are hashed alone.
BLOCK = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word (no word is empty or holds a space): sums of powers over whole blocks at once."""
    if not words:
        return np.zeros(0, np.uint64)
    if not _tables:
        powers = lambda f: np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, f, np.uint64)])
        _tables.extend([powers(_FACTOR), powers(pow(_FACTOR, -1, 1 << 64))])
    power, inverse = _tables
    joined = b" ".join(words)
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(raw)]
    out = np.empty(len(words), np.uint64)
    at = 0
    while at < len(words):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + BLOCK, "right"))
        if to == at:
            out[at] = xxhash.xxh3_64_intdigest(joined[base : int(ends[at])])
            at += 1
            continue
        block = raw[base : int(ends[to - 1])]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_SYMBOL[block] * power[: len(block)], out=sums[1:])
        first = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[first]) * inverse[first]
        at = to
    return mix(out)


def grams(x: np.ndarray, size: int, factor: int = _FACTOR) -> np.ndarray:
    """Hashes of all runs of `size` words from word hashes."""
    n = len(x) - size + 1
    out = x[:n].copy()
    for k in range(1, size):
        out *= np.uint64(factor)
        out += x[k : k + n]
    return mix(out)
