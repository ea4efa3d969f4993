"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (13 words in a row, or the whole item if shorter) are the sets to be contained. For containment, the
prefix that is necessary has one token: the rarest word of the window, by its count over all documents. Documents and
windows are joined on that word only; length and position bounds discard pairs that cannot hold the window, and what is
left is verified word by word over the item.

Benchmark items go to the tasks in blocks of bounded size. One block (the usual case) is one pass without any shuffle;
more blocks are one pass each, whose hits are united by row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, free, materialize, numbered, read, sliced, utf8

#: Text of one block of benchmark items; what a task and the driver hold at once.
BLOCK_BYTES = 8 << 20
#: Words are runs of a-z, 0-9 and all that is not ASCII; A-Z count as a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary stands in all documents; the result is as large as the vocabulary."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        counts: dict[bytes, int] = defaultdict(int)
        is_wanted = wanted.value.__contains__
        for batch in sliced(batches, "text"):
            for text in utf8(batch, "text"):
                for word in filter(is_wanted, words_of(text)):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class WindowIndex:
    """Windows of items by their rarest word: word -> runs (item, place of the word, first and last window start that it stands for)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int], size: int):
        self.items = [(name, words, min(size, len(words))) for name, words in items if words]
        self.by_word: dict[bytes, list[tuple[int, int, int, int]]] = defaultdict(list)
        for k, (_, words, span) in enumerate(self.items):
            rarity = [(counts.get(w, 0), w) for w in words]
            runs: dict[int, list[int]] = {}
            for start in range(len(words) - span + 1):
                place = min(range(start, start + span), key=lambda i: (rarity[i], i))
                runs.setdefault(place, [start, start])[1] = start
            for place, (low, high) in runs.items():
                self.by_word[words[place]].append((k, place, low, high))
        self.by_word = dict(self.by_word)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered stretches [from, to) of the document's words, and the items found."""
        covered, found, n = [], set(), len(words)
        runs_of = self.by_word.get
        is_prefix = self.by_word.__contains__
        for at, word in enumerate(words):
            if not is_prefix(word):
                continue
            for k, place, low, high in runs_of(word):
                name, item, span = self.items[k]
                shift = at - place
                first, last = max(low, -shift), min(high, n - span - shift)  # windows that lie inside the document
                if first > last:
                    continue
                left, floor = place, first
                while left > floor and words[shift + left - 1] == item[left - 1]:
                    left -= 1
                first = max(first, left)
                if first > last:
                    continue
                right, ceiling = place, last + span - 1
                while right < ceiling and words[shift + right + 1] == item[right + 1]:
                    right += 1
                last = min(last, right - span + 1)
                if first <= last:
                    covered.append((shift + first, shift + last + span))
                    found.add(name)
        return covered, found


def union_length(stretches: Iterable[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(stretches):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _named(found: Iterable[str | None]) -> str:
    """The digest of the ids of the items found; a null id names nothing."""
    return hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()


def _verdicts(doc_ids, n_words: list[int], hits: list[tuple[list, set]], share: int) -> pa.RecordBatch:
    n_hit = [union_length(covered) for covered, _ in hits]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for _, f in hits], pa.int64()), pa.array([_named(f) for _, f in hits], pa.string()), pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, flag: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    With a flag, the columns of docs and a boolean of that name instead, for filtering. Null and empty texts have no
    words and are clean; items without words are never found. Items whose id is null are hit like others; a null id counts
    once among the items, as a repeated item_id does, and is left out of items_sha256. Repeated rows come out once each.
    Long texts are searched whole, in time that grows with their length. With an empty benchmark all is clean. Other columns
    are passed by.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    size = bench.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = docs.columns
    kept = docs.select(*names) if flag else docs.select("doc_id", "text")
    number, own_covered, own_items = free([*kept.columns, flag], "row", "covered", "items")
    if blocks > 1:
        kept = numbered(kept, number)  # each block reads the rows anew

    def index(block: int):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r["item_id"], words_of(bytes(r["text"]))) for r in part.collect()]  # one block
        counts = word_counts(docs, {w for _, words in items for w in words})
        return spark.sparkContext.broadcast(WindowIndex(items, counts, window))

    if blocks == 1:
        held = index(0)

        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                texts = [words_of(t) for t in utf8(batch, "text")]
                hits = [held.value.hits(w) for w in texts]
                ids = batch.column("doc_id").cast(pa.int64())
                out = _verdicts(ids, [len(w) for w in texts], hits, share)
                if flag:
                    out = pa.RecordBatch.from_arrays([*batch.columns, out.column("contaminated")], [*batch.schema.names, flag])
                yield out

        schema = kept.withColumn(flag, F.lit(True)).schema if flag else RESULT
        return kept.mapInArrow(judge, schema)

    found = None
    for block in range(blocks):
        held = index(block)

        def search(batches, held=held):
            for batch in sliced(batches, "text"):
                rows, covered, names = [], [], []
                for row, text in zip(batch.column(number).to_pylist(), utf8(batch, "text"), strict=True):
                    stretches, items = held.value.hits(words_of(text))
                    if items:
                        rows.append(row)
                        covered.append(np.array(stretches, "<i8").tobytes())
                        names.append(list(items))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(covered, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["row", "covered", "items"])

        part = materialize(kept.select(number, "text").mapInArrow(search, "row long, covered binary, items array<string>"), "hits")
        found = part if found is None else found.unionByName(part)
    by_row = found.groupBy(F.col("row").alias(number)).agg(F.collect_list("covered").alias(own_covered), F.flatten(F.collect_list("items")).alias(own_items))

    def merge(batches):
        for batch in sliced(batches, "text"):
            n_words = [len(words_of(t)) for t in utf8(batch, "text")]
            hits = [([tuple(x) for c in cov or [] for x in np.frombuffer(c, "<i8").reshape(-1, 2).tolist()], set(items or [])) for cov, items in zip(batch.column(own_covered).to_pylist(), batch.column(own_items).to_pylist(), strict=True)]
            out = _verdicts(batch.column("doc_id").cast(pa.int64()), n_words, hits, share)
            if flag:
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out.column("contaminated")], [*names, flag])
            yield out

    schema = kept.drop(number).withColumn(flag, F.lit(True)).schema if flag else RESULT
    return kept.join(by_row, number, "left").mapInArrow(merge, schema)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS span, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM windows),
grams AS (
  SELECT rid, span, s, array_to_string(w[s:s + span - 1], ' ') AS words
  FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM dw, spans WHERE len(w) >= span)),
hits AS (SELECT DISTINCT rid, s, span, item_id FROM grams JOIN windows USING (span, words)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + span)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
