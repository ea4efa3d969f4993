"""WARC records and a Merkle audit of their replicas.

Pages become WARC resource records in segment files, each record at its byte offset. A replica is read back from its
files, framed by the lengths that its records state, and every record is hashed as it lies there. Both copies make trees:
a leaf is the digest of a record, an inner node the digest of its children in an ordered range of offsets, and ranges
grow sixteenfold per level up to one root per segment. Only the children of nodes that differ are compared on the next
level, so an intact segment costs one comparison, and a damaged record one path. A lost record shifts all later ones of
its segment; in the ranges that differ, records are therefore paired by place, digest and id in turn.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free, give_back, materialize, numbered, read, shared_dir

#: Bytes of a segment, about; what one task reads at a time. A longer record makes a segment longer.
SEGMENT_BYTES = 8 << 20
#: Bytes of the smallest range, whose records make one node, and how many nodes make one above.
RANGE, FANOUT = 65_536, 16
#: When the records were taken; all of a collection bear one date.
DATE = "2024-01-01T00:00:00Z"


def record(url: Column, page_id: Column, row: Column, body: Column, date: str = DATE) -> Column:
    """A WARC resource record as text: header, empty line, content, two line ends. Its id follows from the row's number."""
    content = F.coalesce(body, F.lit(""))
    h = F.md5(F.concat_ws("|", F.lit("tidemark"), row.cast("string")))
    uid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # A url is one header line; line ends in it, which no url has, would end the header.
    target = F.translate(F.coalesce(url, F.lit("")), "\r\n", "")
    fields = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nPage-ID: "), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"),
    ]
    return F.concat(*fields, F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, row, segment, record. Segments are dealt by row number, so that they are even whatever the ids are."""
    (row,) = free(pages.columns, "row")
    rows = numbered(pages, row)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 400)).first()[0] or 0
    segments = max(1, -(-size // SEGMENT_BYTES))
    text = record(F.col("url"), F.col("page_id"), F.col(row), F.col("html"))
    return rows.select("page_id", F.col(row).alias("row"), F.pmod(F.xxhash64(row), F.lit(segments)).cast("int").alias("segment"), text.alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """page_id, row, segment, record_id, offset, length, digest of each record; only places and digests are shuffled, not the records."""
    identity = F.regexp_extract("record", r"WARC-Record-ID: (<[^>]*>)", 1).alias("record_id")
    light = records.select("page_id", "row", "segment", identity, F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record"), 256).alias("digest"))
    order = Window.partitionBy("segment").orderBy("row")
    return light.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def write_segments(records: DataFrame, path: str) -> None:
    """Writes the records in order of their rows, one file (compressed as a whole) in a folder for each segment."""
    body = F.expr("substr(record, 1, char_length(record) - 4)")  # the writer ends each record with the two line ends
    rows = records.repartition(F.col("segment")).sortWithinPartitions("segment", "row")
    rows.select("segment", body.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("segment").text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*?)\r\n")


def framed(raw: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Offset, length, header fields and content of each record; what is no record up to the next one has no header.

    Records are framed by the lengths that they state, so contents may hold anything, headers of records included.
    """
    at = 0
    while at < len(raw):
        m = HEAD.match(raw, at)
        fields = {}
        if m:
            for line in m[1].split(b"\r\n")[:-1]:
                name, _, value = line.partition(b":")
                fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = fields.get("content-length", "")
        end = m.end() + int(size) + 4 if m and size.isdigit() else -1
        if m and size.isdigit() and raw[end - 4 : end] == b"\r\n\r\n":
            yield at, end - at, fields, raw[m.end() : end - 4]
            at = end
            continue
        then = raw.find(b"\r\n\r\nWARC/1.", at + 1)
        end = len(raw) if then < 0 else then + 4
        yield at, end - at, None, raw[at:end]
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """segment, offset, length, record_id, page_id, url, html, digest, intact of all records in the segment files below path.

    intact: the stretch is framed as a record. A stretch that is not (a length that does not fit, a torn file) has its
    place and digest only; reading goes on at the next record.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, content in zip(batch.column("segment").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                raw = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
                rows = []
                for offset, length, fields, body in framed(raw):
                    known = fields or {}
                    rows.append((segment, offset, length, known.get("warc-record-id"), known.get("page-id") or None, known.get("warc-target-uri"), body.decode("utf-8", "replace") if fields else None, hashlib.sha256(raw[offset : offset + length]).hexdigest(), fields is not None))
                names = ["segment", "offset", "length", "record_id", "page_id", "url", "html", "digest", "intact"]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names)
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    segment = F.regexp_extract("path", r"segment=(\d+)/[^/]*$", 1).cast("int")
    return files.select(segment.alias("segment"), "content").mapInArrow(run, "segment int, offset long, length long, record_id string, page_id string, url string, html string, digest string, intact boolean")


def tree(table: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (segment, node, digest) from the smallest ranges to the roots."""
    out, span = [], RANGE
    children = table.select("segment", F.col("offset").alias("child"), "digest")
    for level in range(levels):
        parent = F.floor(F.col("child") / span) if level == 0 else F.floor(F.col("child") / FANOUT)
        # A range holds a bounded number of children: records that begin in it, or FANOUT nodes.
        nodes = children.withColumn("node", parent.cast("long")).groupBy("segment", "node").agg(F.array_sort(F.collect_list(F.struct("child", "digest"))).alias("c"))
        nodes = nodes.select("segment", "node", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(" ", x["child"].cast("string"), x["digest"])), "\n"), 256).alias("digest"))
        out.append(nodes)
        children = nodes.select("segment", F.col("node").alias("child"), "digest")
    return out


Stored = tuple[int, str | None, str]  # offset, record_id and digest of a record


def paired(primary: list[Stored], replica: list[Stored]) -> list[tuple[str, Stored | None, Stored | None]]:
    """Each record of one segment with what the replica has of it, and what is left over, by status.

    In turn, each pairing what is left by then in order of places: what is the same at its place is intact; what bears its
    id at its place is altered; what is the same elsewhere has moved; what bears its id elsewhere is altered; what has lost
    its id is what lies at its place. A record of which nothing is left is missing; what belongs to none is extra.
    """
    rules = [
        ("intact", lambda r: (r[0], r[2])),
        ("altered", lambda r: r[:2] if r[1] is not None else None),
        ("moved", lambda r: r[2]),
        ("altered", lambda r: r[1]),
        ("altered", lambda r: r[0]),
    ]
    left, right, out = sorted(primary, key=str), sorted(replica, key=lambda r: r[0]), []
    left.sort(key=lambda r: r[0])
    for status, key in rules:
        waiting: dict = {}
        for k, r in enumerate(right):
            if key(r) is not None:
                waiting.setdefault(key(r), []).append(k)
        used, rest = set(), []
        for r in left:
            found = waiting.get(key(r)) if key(r) is not None else None
            if found:
                used.add(found[0])
                out.append((status, r, right[found.pop(0)]))
            else:
                rest.append(r)
        left, right = rest, [r for k, r in enumerate(right) if k not in used]
    return out + [("missing", r, None) for r in left] + [("extra", None, r) for r in right]


FOUND = "segment int, offset long, record_id string, status string, primary_sha256 string, replica_sha256 string, replica_offset long"


def _pair(x: pa.Table, y: pa.Table) -> pa.Table:
    rows = lambda t: list(zip(*(t.column(c).to_pylist() for c in ("offset", "record_id", "digest")), strict=True))
    segment = (x if len(x) else y).column("segment")[0].as_py()
    out = [(segment, (p or r)[0], (p or r)[1], status, p and p[2], r and r[2], r and r[0]) for status, p, r in paired(rows(x), rows(y)) if status != "intact"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """segment, offset, record_id, status (altered, moved, missing or extra), both digests and the offset in the replica of records
    in ranges that differ; offset and record_id are the primary's, or those of an extra.

    Both tables: segment, offset, digest, record_id (null where a header is torn). A place in a segment holds one record; ids
    may be repeated or missing, and records may stand twice or in another order. Equal tables, empty ones included, give no
    rows. A segment's differing ranges are paired in one task, which a segment's size bounds.
    """
    spark = primary.sparkSession
    left, right = (materialize(t.select("segment", "offset", "digest", "record_id"), "leaves") for t in (primary, replica))
    last = max(left.agg(F.max("offset")).first()[0] or 0, right.agg(F.max("offset")).first()[0] or 0)
    levels = 1
    while RANGE * FANOUT ** (levels - 1) <= last:
        levels += 1
    a, b = ([materialize(t, "nodes") for t in tree(x, levels)] for x in (left, right))
    suspect = None
    passed = []
    for level in reversed(range(levels)):
        x, y = (t[level] for t in (a, b))
        if suspect is not None:
            inside = suspect.select("segment", F.col("node").alias("above"))
            x, y = (t.withColumn("above", F.floor(F.col("node") / FANOUT).cast("long")).join(inside, ["segment", "above"], "left_semi").drop("above") for t in (x, y))
        pairs = x.withColumnRenamed("digest", "d1").join(y.withColumnRenamed("digest", "d2"), ["segment", "node"], "full")
        suspect = materialize(pairs.where(~F.col("d1").eqNullSafe(F.col("d2"))).select("segment", "node"), "suspect")
        passed.append(suspect)
    x, y = (t.withColumn("node", F.floor(F.col("offset") / RANGE).cast("long")).join(suspect, ["segment", "node"], "left_semi").drop("node").groupBy("segment") for t in (left, right))
    found = materialize(x.cogroup(y).applyInArrow(_pair, FOUND), "found")
    discard(spark, left, right, *a, *b, *passed)
    return found


def damaged(records: DataFrame) -> DataFrame:
    """A stand-in for a replica that has suffered: of crc32(page_id) mod 97, rest 5 changed its last characters, rest 11 lost the record."""
    rest = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(97))
    changed = F.concat(F.expr("substr(record, 1, char_length(record) - 6)"), F.lit("??\r\n\r\n"))
    return records.where(rest != 11).withColumn("record", F.when(rest == 5, changed).otherwise(F.col("record")))


def fixity(pages: DataFrame, spoil=damaged) -> DataFrame:
    """page_id, length, primary_sha256, replica_sha256, status (intact, moved, altered or missing) for the record of every row, and
    a row without page_id and primary_sha256 for each extra record of the replica.

    The replica is written to segment files, spoilt, and read back from them. Null urls, ids and html make records with
    empty fields. Repeated rows are records of their own, with ids of their own. Long pages are records like any other.
    Empty tables give no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    source = records(pages.select("page_id", "url", "html"))
    table = materialize(leaves(source), "records")
    path = f"{shared_dir(spark).rstrip('/')}/replica-{uuid.uuid4().hex}"
    write_segments(spoil(source), path)
    held = materialize(read_records(spark, path).select("segment", "offset", "length", "digest", "record_id"), "replica")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    found = audit(table, held)
    wrong = found.where("status <> 'extra'").select("segment", "offset", "status", "replica_sha256")
    joined = table.join(wrong, ["segment", "offset"], "left")
    replica = F.when(F.col("status").isNull(), F.col("digest")).otherwise(F.col("replica_sha256"))
    rows = joined.select("page_id", "length", F.col("digest").alias("primary_sha256"), replica.alias("replica_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))
    extra = found.where("status = 'extra'").select("segment", "offset", "replica_sha256", "status").join(held.select("segment", "offset", "length"), ["segment", "offset"])
    return rows.unionByName(extra.select("length", "replica_sha256", "status"), allowMissingColumns=True)


def op3_warc_fixity(spark, sf_dir: str) -> DataFrame:
    return fixity(read(spark, sf_dir, "pages"))
