"""Repeated word windows by compressed FM-indexes over content-routed shards.

A window of 35 words has a marker: the least hash of its 8-word runs. Equal windows have equal markers, so stretches of
text whose windows share a marker are sent to the shard of that marker, and only if the marker is found more than once;
all places where a window can occur are then in one shard, and each text is streamed past one index only, however many
shards there are. A shard builds an FM-index of its stretches (Burrows-Wheeler transform in a wavelet matrix of packed
bits with rank directories) and runs backward search for all its stretches side by side. The matching statistics it
gets (how long a match ends at a place that occurs at least twice) are reported as intervals of repeated windows.

Stretches of equal content go to the shuffle once per task and stand in the index once, with their number; copies cost
no index space, and a content that shares its marker with no other needs none at all: its windows occur as often as it
does. A marker with more than HOT places could still overfill a shard with contents that differ only at their
ends. Its different contents are therefore cut into single windows, which are routed by the hash of the whole window
instead; those whose hash is found more than once go to the indexes of these finer shards. Hashes only decide what
meets in a shard: what counts as equal is decided by the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import bound_batches, discard, free, give_back, grams, materialize, numbered, read, sliced, utf8, word_hashes

WINDOW = 35
#: Words of the runs whose least hash is a window's marker.
GRAM = 8
#: Places of one marker that a shard takes; the contents of more common markers are routed window by window.
HOT = 2_000
#: Words of a shard, about: bounds what one task indexes at a time.
SHARD_WORDS = 600_000
#: Longest pattern that an index answers; suffixes are sorted by so many words.
ORDER = 64
#: Bytes of different contents that a task knows at a time.
HELD_BYTES = 16 << 20


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def stretches(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, marker, and weight (2 if the marker is there twice) of each stretch of texts."""
    gram = min(GRAM, window)
    texts = [(k, words) for k, words in enumerate(texts) if len(words) >= window]
    if not texts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sizes = np.array([len(words) for _, words in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    g = grams(word_hashes([w for _, words in texts for w in words]), gram)
    over = (ends[:-1, None] - np.arange(1, gram)).ravel()  # runs over the end of a text
    g[over] = np.uint64(2**64 - 1)
    marker = sliding_min(g, window - gram + 1)
    new = np.r_[True, marker[1:] != marker[:-1]]
    new[begins] = True
    after = begins + sizes - window + 1  # the first places that have no window of the text before
    new[after[after < len(new)]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(marker)])
    text = np.searchsorted(ends, start, "right")
    inside = start < after[text]
    start, size, text = start[inside], size[inside], text[inside]
    # How often the marker stands among the runs of a stretch.
    span = size + window - gram
    first = np.cumsum(span) - span
    at = np.arange(int(span.sum())) - np.repeat(first - start, span)
    times = np.add.reduceat((g[at] == np.repeat(marker[start], span)).astype(np.int32), first)
    which = np.array([k for k, _ in texts], np.int64)
    return which[text], start - begins[text], size, marker[start], 1 + (times > 1)


class FMIndex:
    """Counts of word sequences of up to ORDER words in a text of symbols, by backward search; positions are 32-bit."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        self.n = n
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int32)
        symbols = np.roll(text, 1)[self._order(text)]
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32))
            self.zeros.append(np.int32(n - np.count_nonzero(bit)))
            symbols = np.r_[symbols[~bit], symbols[bit]]
        # Where each symbol's run begins after all levels, less what stands before it in the sorted text.
        change = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if n else np.zeros(0, np.int64)
        begin = np.zeros(sigma, np.int32)
        begin[symbols[change]] = change
        self.shift = self.before[:-1] - begin

    @staticmethod
    def _order(text: np.ndarray) -> np.ndarray:
        """Positions sorted by the ORDER symbols that follow, cyclically."""
        rank, span = text.astype(np.int64), 1
        while True:
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -span)
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            span *= 2
            if span >= ORDER or rank.max(initial=0) == len(text) - 1:
                return order

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of sequences that begin with symbol and go on as those of rows [low, high)."""
        at = np.concatenate([low, high])
        wanted = np.concatenate([symbol, symbol])
        for k, (bits, ranks, zeros) in enumerate(zip(self.bits, self.ranks, self.zeros, strict=True)):
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(bits[word] & BELOW[at & 63])
            one = (wanted >> (self.levels - 1 - k)) & 1
            at = np.where(one, zeros + ones, at - ones)
        at += self.shift[wanted]
        return at[: len(low)], at[len(low) :]

    def matched(self, text: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Matching statistics: the length, up to limit, of the longest sequence ending at each place of text that occurs twice or more."""
        length = np.zeros(len(end), np.int32)
        lane = np.arange(len(end))
        symbol = text[end]
        low, high = self.before[symbol], self.before[symbol + 1]  # sequences of one symbol
        while True:
            twice = high - low >= 2
            length[lane[twice]] += 1
            on = twice & (length[lane] < limit[lane])
            lane, low, high = lane[on], low[on], high[on]
            if not len(lane):
                return length
            low, high = self.step(text[end[lane] - length[lane]], low, high)


#: Masks of the bits below each place of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def repeated_windows(segments: list[list[bytes]], window: int = WINDOW, known: list[bool] | None = None) -> list[np.ndarray]:
    """For each segment (of at least window words), which of its windows occur at least twice in all segments.

    Segments that are known to stand for several places have no need of a search: all their windows occur again.
    """
    words = [w for s in segments for w in (*s, b"")]  # an empty word ends a segment
    code = dict.fromkeys(words)
    for k, w in enumerate(code):
        code[w] = k
    text = np.fromiter(map(code.__getitem__, words), np.int32, len(words))
    sigma = len(code)
    del words, code
    sizes = np.array([len(s) for s in segments], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    index = FMIndex(text, sigma)
    windows = sizes - window + 1
    place = np.r_[0, np.cumsum(windows)]
    found = np.zeros(int(place[-1]), bool)
    longest = ORDER - window + 1
    # Each segment goes from its first window on, with as many windows at a time as have matched so far; after a miss of
    # a single window, the next one that can match begins where its longest match began.
    at, gallop = np.zeros(len(segments), np.int64), np.minimum(windows, longest)
    lane = np.arange(len(segments))
    if known is not None:
        for k in np.flatnonzero(known).tolist():
            found[place[k] : place[k + 1]] = True
        lane = lane[~np.array(known, bool)]
    while len(lane):
        g = np.minimum(gallop[lane], windows[lane] - at[lane])
        end = first[lane] + at[lane] + window + g - 2
        length = index.matched(text, end, window + g - 1)
        full = length == window + g - 1
        for k, a, n in zip(lane[full].tolist(), at[lane[full]].tolist(), g[full].tolist(), strict=True):
            found[place[k] + a : place[k] + a + n] = True
        jump = np.where(full, g, np.where(g == 1, window - length, 0))
        at[lane] += jump
        gallop[lane] = np.where(full, np.minimum(2 * g, longest), np.maximum(g // 2, 1))
        lane = lane[at[lane] < windows[lane]]
    return [found[place[k] : place[k + 1]] for k in range(len(segments))]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the true stretches."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - edge[::2]


def _spots(texts: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """row, start, size, marker (as a signed long), hot: the stretches whose marker is found more than once; and the tables stored for them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            text, start, size, marker, weight = stretches([(t or b"").split() for t in utf8(batch, "text")], window)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(marker.view(np.int64)), pa.array(weight.astype(np.int32))], ["row", "start", "size", "marker", "weight"])

    spots = materialize(texts.select("row", "text").mapInArrow(run, "row long, start int, size int, marker long, weight int"), "spots")
    often = materialize(spots.groupBy("marker").agg(F.sum("weight").alias("n")).where("n > 1").select("marker", (F.col("n") > HOT).alias("hot")), "often")
    return spots.drop("weight").join(often, "marker").select("row", "start", "size", "marker", "hot"), [spots, often]


def _content(split: list[bytes], start: int, size: int, window: int) -> tuple[bytes, bytes]:
    words = b" ".join(split[start : start + size + window - 1])
    return xxhash.xxh3_128_digest(words), words


def _places(texts: DataFrame, window: int) -> DataFrame:
    """row, start, key, and for a shard marker, hot, words, again: the stretches of texts (row, text, spots).

    A task sends the words of a content once, and a second time without them (again), which says that it is repeated;
    further copies are only places. What a task knows is bounded by HELD_BYTES; then it begins anew.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        held = 0
        for batch in sliced(batches, "text"):
            rows, start, keys, marker, hot, sent, again = [], [], [], [], [], [], []
            for row, text, spots in zip(batch.column("row").to_pylist(), utf8(batch, "text"), batch.column("spots").to_pylist(), strict=True):
                split = text.split()
                for s in spots:
                    key, words = _content(split, s["start"], s["size"], window)
                    state = known.get(key)
                    if state is None:
                        held += len(words)
                    rows.append(row)
                    start.append(s["start"])
                    keys.append(key)
                    marker.append(s["marker"])
                    hot.append(s["hot"])
                    sent.append(words if state is None else None)
                    again.append(state is False)
                    known[key] = state is not None
                if held > HELD_BYTES:
                    known.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(start, pa.int32()), pa.array(keys, pa.binary()), pa.array(marker, pa.int64()), pa.array(hot, pa.bool_()), pa.array(sent, pa.binary()), pa.array(again, pa.bool_())], ["row", "start", "key", "marker", "hot", "words", "again"])

    return texts.select("row", "text", "spots").mapInArrow(run, "row long, start int, key binary, marker long, hot boolean, words binary, again boolean")


def _searched(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """key, a, n: runs of n repeated windows from a on, per content; contents (marker, key, words, n) of a marker meet in one shard."""

    def search(table: pa.Table) -> pa.Table:
        found: dict[bytes, list] = {}
        alone: dict[int, bytes | None] = {}  # the only content of a marker
        for m, k, w, n in zip(*(table.column(c).to_pylist() for c in ("marker", "key", "words", "n")), strict=True):
            held = found.setdefault(k, [None, 0])
            held[0] = held[0] or w
            held[1] += n
            if alone.setdefault(m, k) != k:
                alone[m] = None
        lone = {k for k in alone.values() if k is not None and found[k][1] > 1}
        some = [k for k in found if k not in lone]
        flagged = repeated_windows([found[k][0].split() for k in some], window, [found[k][1] > 1 for k in some]) if some else []
        keys, first, size = [], [], []
        for k, flags in zip(some, flagged, strict=True):
            a, n = runs(flags)
            if len(a):
                keys.append(k)
                first.append(a)
                size.append(n)
        for k in lone:
            keys.append(k)
            first.append([0])
            size.append([found[k][0].count(b" ") + 2 - window])
        out = pa.table([pa.array(keys, pa.binary()), pa.array(first, pa.list_(pa.int32())), pa.array(size, pa.list_(pa.int32()))], ["key", "a", "n"])
        del found, flagged, table
        give_back()
        return out

    sharded = contents.select(F.pmod("marker", F.lit(shards)).alias("shard"), "marker", "key", "words", "n")
    return sharded.groupBy("shard").applyInArrow(search, "key binary, a array<int>, n array<int>")


def _shards(contents: DataFrame) -> int:
    """As many shards as the words that are there need, copies apart."""
    total = contents.select(F.sum(F.length("words"))).first()[0] or 0
    return max(1, -(-total // (6 * SHARD_WORDS)))


def _hot_searched(places: DataFrame, window: int) -> DataFrame | None:
    """key, a, n as from _searched for the contents of hot markers, which are cut into windows of their own shards."""
    spark = places.sparkSession
    sent = places.where("hot and (words is not null or again)")
    if sent.isEmpty():
        return None
    contents = materialize(sent.groupBy("key").agg(F.max("words").alias("words"), F.count("*").alias("n")), "hot")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "words"):
            hashes = [grams(word_hashes(w.split()), window).view(np.int64) for w in batch.column("words").to_pylist()]
            at = [np.arange(len(h), dtype=np.int32) for h in hashes]
            which = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(which), batch.column("n").take(which), pa.array(np.concatenate(at)), pa.array(np.concatenate(hashes))], ["key", "n", "i", "marker"])

    windows = materialize(contents.mapInArrow(hashed, "key binary, n long, i int, marker long"), "windows")
    twice = windows.groupBy("marker").agg(F.sum("n").alias("n")).where("n > 1").select("marker")
    wanted = windows.join(twice, "marker").groupBy("key").agg(F.collect_list(F.struct("i", "marker")).alias("at"))  # windows of one content
    wanted = materialize(contents.join(wanted, "key"), "wanted")

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different window of some contents with its number, and the contents and places that it stands for."""
        for batch in sliced(batches, "words"):
            out: dict[bytes, list] = {}
            for key, words, n, at in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "n", "at")), strict=True):
                split = words.split()
                for x in at:
                    k, w = _content(split, x["i"], 1, window)
                    held = out.setdefault(k, [x["marker"], w, 0, [], []])
                    held[2] += n
                    held[3].append(key)
                    held[4].append(x["i"])
            marker, words, n, keys, places = zip(*out.values(), strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(marker, pa.int64()), pa.array(out, pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(places, pa.list_(pa.int32()))], ["marker", "key", "words", "n", "of", "i"])

    singles = materialize(wanted.mapInArrow(single, "marker long, key binary, words binary, n long, of array<binary>, i array<int>"), "singles")
    repeated = _searched(singles.select("marker", "key", "words", "n"), window, _shards(singles)).select("key")
    places = singles.join(repeated, "key").select(F.explode(F.arrays_zip("of", "i")).alias("x")).select(F.col("x.of").alias("key"), F.col("x.i").alias("i"))
    known = places.groupBy("key").agg(F.array_sort(F.collect_list("i")).alias("a"))  # windows of one content
    out = materialize(known.select("key", "a", F.transform("a", lambda _: F.lit(1)).alias("n")), "known")
    discard(spark, contents, windows, wanted, singles)
    return out


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """row, start, a, n: runs of n repeated windows from start + a on, as two arrays; texts: row, text, spots."""
    places = materialize(_places(texts, window), "places")
    contents = places.where("not hot and (words is not null or again)").select("marker", "key", "words", F.lit(1).cast("long").alias("n"))
    known = materialize(_searched(contents, window, _shards(contents)), "known")
    hot = _hot_searched(places, window)
    if hot is not None:
        known = known.unionByName(hot)
    return places.select("row", "start", "key").join(known, "key").select("row", "start", "a", "n")


def removal(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if not spans:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        for a, n in zip(s["a"], s["n"], strict=True):
            depth[s["start"] + a] += 1
            depth[s["start"] + a + n + window - 1] -= 1
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]


def _removed(docs: DataFrame, window: int, keep_all: bool) -> DataFrame:
    """rest (a struct of the columns of docs but text), text, words (their number), kept (words left) and sha per row.

    With keep_all, text is what is left (the text itself if all is), else null.
    """
    bound_batches(docs.sparkSession)
    (row,) = free(docs.columns, "row")
    rows = numbered(docs, row)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    texts = rows.select(F.col(row).alias("row"), F.struct(F.col(row), *others).alias("rest"), F.col("text").cast("string").alias("text"))
    # Spans depend on the text alone; rows keep their numbers for both reads.
    spots, held = _spots(texts, window)
    listed = spots.groupBy("row").agg(F.collect_list(F.struct("start", "size", "marker", "hot")).alias("spots"))
    result = StructType([texts.schema["rest"], StructField("text", StringType()), StructField("words", LongType()), StructField("kept", LongType()), StructField("sha", StringType())])

    def digest(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        n_words, n_kept, sha, left = [], [], [], []
        for text, s in zip(utf8(batch, "text"), spans, strict=True):
            words = (text or b"").split()
            kept = removal(words, s, window)
            n_words.append(len(words))
            n_kept.append(len(kept))
            whole = b" ".join(kept)
            sha.append(hashlib.sha256(whole).hexdigest())
            left.append(text if len(kept) == len(words) else whole)
        text = pa.array(left, pa.binary()).cast(pa.string()) if keep_all else pa.nulls(len(left), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("rest"), text, pa.array(n_words, pa.int64()), pa.array(n_kept, pa.int64()), pa.array(sha, pa.string())], result.names)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of texts without candidate windows at once; the others keep their text for the search."""
        for batch in sliced(batches, "text"):
            free_of = batch.filter(batch.column("spots").is_null())
            if free_of.num_rows:
                yield pa.RecordBatch.from_arrays([free_of.column("row"), free_of.column("spots"), *digest(free_of, [None] * free_of.num_rows).columns], ["row", "spots", *result.names])
            rest = batch.filter(batch.column("spots").is_valid())
            if n := rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column("row"), rest.column("spots"), rest.column("rest"), rest.column("text"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], ["row", "spots", *result.names])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield digest(batch, batch.column("spans").to_pylist())

    spot = StructType([StructField("start", IntegerType()), StructField("size", IntegerType()), StructField("marker", LongType()), StructField("hot", listed.schema["spots"].dataType.elementType["hot"].dataType)])
    joined = materialize(texts.join(listed, "row", "left").select("row", "rest", "text", "spots").mapInArrow(split, StructType([StructField("row", LongType()), StructField("spots", ArrayType(spot)), *result.fields])), "texts")
    discard(docs.sparkSession, *held)
    found = joined.where("spots is not null").select("row", "rest", "text", "spots")
    spans = repeated_spans(found, window).groupBy("row").agg(F.collect_list(F.struct("start", "a", "n")).alias("spans"))
    some = found.drop("spots").join(spans, "row", "left").select("rest", "text", "spans").mapInArrow(cut, result)
    return joined.where("spots is null").select(*result.names).unionByName(some)


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row: words covered by a window that occurs anywhere else are removed.

    Null and empty texts have no words. Texts of fewer words than a window lose none; long texts are taken whole. All
    occurrences go, the first included; repeated rows therefore lose all windows. Null and repeated doc_ids are rows like
    any other. Empty tables give no rows. Other columns are not read.
    """
    out = _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, False)
    return out.select(F.col("rest.doc_id").alias("doc_id"), F.col("words").alias("n_words"), (F.col("words") - F.col("kept")).alias("n_removed"), F.col("sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words removed from text: words left are joined by one space, texts that lose none stay as they are.

    n_chars, if there, is made to fit. All rows stay, those of null and empty texts as they are; a text of which nothing
    is left is empty. Ties, repeated rows, long texts and empty tables are as in repeated_words. Columns may have any names.
    """
    out = _removed(docs, window, True)
    columns = {c: F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("kept") < F.col("words"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_words(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(s, s + 35)) AS p FROM g JOIN twice USING (h)) GROUP BY rid),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d JOIN gone USING (rid)),
flat AS (SELECT rid, unnest(ps) AS p FROM gone),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN flat USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
