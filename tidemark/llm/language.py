"""Language identification by a convolutional network over bytes.

Bytes get short vectors; filters of several widths slide over them; each filter's largest answer in a window of fixed
length goes to a softmax over languages. The network is trained in numpy on windows of labelled texts. For scoring it is
rewritten as tables by pairs of bytes: an answer of a filter is then a sum of two looked-up rows. A text is cut into
windows from end to end, and their probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, free, per_worker, read, sliced, utf8

#: Languages and texts of each that the fit uses at most, and windows of a text, evenly over it. Every other one is cut to
#: at most SHORT bytes, as texts of a few words are to be told too.
MAX_LANGUAGES, MAX_TEXTS, TEXT_WINDOWS, SHORT = 200, 500, 4, 40
#: Rows are held out where crc32 of the doc_id as text, modulo FOLDS, is HELD.
FOLDS, HELD = 4, 2
#: Bytes of a window. A filter's last bytes may lie in the next one, so that no run of bytes is missed.
LENGTH = 125
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
#: Stands for what is beyond a text's end; UTF-8 has no such byte.
PAD = 0xFF
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.004, 11
#: Positions that tables are looked up for at a time.
AT_ONCE = 1 << 14
UNKNOWN = "und"


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # byte, vector
    filters: list[np.ndarray]  # by width: place, vector, filter
    bias: np.ndarray  # of all filters
    dense: np.ndarray  # filter, language
    offset: np.ndarray  # language


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other, each filled up to whole windows with room for a filter beyond its end: bytes, how many
    windows each text has, and how many bytes of the text are in each window."""
    ahead = max(WIDTHS) - 1
    windows = [-(-(len(t) + ahead) // LENGTH) for t in texts]
    joined = b"".join(t + bytes([PAD]) * (w * LENGTH - len(t)) for t, w in zip(texts, windows, strict=True)) + bytes([PAD]) * ahead
    held = [np.clip(len(t) - np.arange(w) * LENGTH, 0, LENGTH) for t, w in zip(texts, windows, strict=True)]
    return np.frombuffer(joined, np.uint8), np.array(windows, np.int64), np.concatenate([np.zeros(0, np.int64), *held])


def answers(network: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest answer in each window (rows of LENGTH bytes and those that a filter needs beyond), and its place."""
    e = network.embedding[windows]
    best, places = [], []
    for width, f in zip(WIDTHS, network.filters, strict=True):
        out = sum(e[:, k : k + LENGTH] @ f[k] for k in range(width))
        places.append(out.argmax(1))
        best.append(out.max(1))
    return np.concatenate(best, 1) + network.bias, np.concatenate(places, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(network: Network, best: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(best, 0) @ network.dense + network.offset)


def gradients(network: Network, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean loss of a batch, and its derivatives: embedding, filters by width, bias, dense, offset. Only the place of
    a filter's largest answer has a share in it."""
    best, places = answers(network, windows)
    p = probabilities(network, best)
    rows = np.arange(len(labels))
    share = weights / weights.sum()
    loss = float(-(share * np.log(np.maximum(p[rows, labels], 1e-30))).sum())
    d = p.copy()
    d[rows, labels] -= 1
    d *= share[:, None]
    hidden = np.maximum(best, 0)
    back = (d @ network.dense.T) * (best > 0)
    embedding, filters, at = np.zeros_like(network.embedding), [], 0
    for width, f in zip(WIDTHS, network.filters, strict=True):
        mine = back[:, at : at + f.shape[2]]
        place = places[:, at : at + f.shape[2]]
        own = np.empty_like(f)
        for k in range(width):
            seen = windows[rows[:, None], place + k]  # window, filter
            own[k] = np.einsum("wf,wfe->ef", mine, network.embedding[seen])
            np.add.at(embedding, seen.ravel(), (mine[:, :, None] * f[k].T[None]).reshape(-1, f.shape[1]))
        filters.append(own)
        at += f.shape[2]
    return loss, [embedding, *filters, back.sum(0), hidden.T @ d, d.sum(0)]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to windows and the numbers of their languages; languages weigh alike, however many windows they have."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    some = len(WIDTHS) * FILTERS
    values = [normal(256, EMBEDDED, by=0.5), *(normal(w, EMBEDDED, FILTERS, by=(w * EMBEDDED) ** -0.5) for w in WIDTHS), np.zeros(some, np.float32), normal(some, len(languages), by=some**-0.5), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    made = lambda: Network(languages, values[0], values[1 : 1 + len(WIDTHS)], *values[1 + len(WIDTHS) :])
    counts = np.bincount(labels, minlength=len(languages))
    weights = (1 / np.maximum(counts, 1))[labels].astype(np.float32)
    step, steps = 0, epochs * -(-len(labels) // BATCH)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _, slopes = gradients(made(), windows[some], labels[some], weights[some])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for v, g, m, s in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return made()


def tables(network: Network) -> tuple[np.ndarray, np.ndarray]:
    """What a pair of bytes adds to every filter at its first two places, and to the wider ones at the two places after."""
    e = network.embedding
    place = lambda f, k: e @ f[k] if k < len(f) else np.zeros((256, f.shape[2]), np.float32)
    pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
    now = np.concatenate([pair(place(f, 0), place(f, 1)) for f in network.filters], 1)
    then = np.concatenate([pair(place(f, 2), place(f, 3)) for f in network.filters[1:]], 1)
    return np.ascontiguousarray(now, np.float32), np.ascontiguousarray(then, np.float32)


@per_worker
def _ready(packed: bytes) -> tuple[Network, np.ndarray, np.ndarray]:
    network = pickle.loads(packed)
    return network, *tables(network)


def looked_up(network: Network, raw: np.ndarray, now: np.ndarray, then: np.ndarray) -> Iterator[np.ndarray]:
    """answers() of the windows of a layout in their order, some at a time, from tables."""
    windows, step = (len(raw) - (max(WIDTHS) - 1)) // LENGTH, AT_ONCE // LENGTH
    wider = now.shape[1] - then.shape[1]
    for k in range(0, windows, step):
        many = min(step, windows - k)
        some = raw[k * LENGTH : (k + many) * LENGTH + max(WIDTHS) - 1]
        pairs = some[:-1].astype(np.uint16) << 8
        pairs |= some[1:]
        x = now[pairs[: many * LENGTH]]
        x[:, wider:] += then[pairs[2 : 2 + many * LENGTH]]
        yield x.reshape(many, LENGTH, -1).max(1) + network.bias


def identify(network: Network, texts: list[bytes], now: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, and its probability: the mean over windows by the bytes they hold."""
    raw, windows, held = layout(texts)
    p = np.concatenate([probabilities(network, best) for best in looked_up(network, raw, now, then)]).astype(np.float64)
    p *= held[:, None]
    first = np.cumsum(windows) - windows
    total = np.add.reduceat(p, first, 0) / np.maximum(np.add.reduceat(held, first), 1)[:, None]
    best = total.argmax(1)
    return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def sample(docs: DataFrame, max_texts: int = MAX_TEXTS, max_languages: int = MAX_LANGUAGES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of labelled texts that are not held out, the numbers of their languages, and the languages.

    At most max_texts texts of each of the max_languages most frequent languages, those with the least hashes, and at most
    TEXT_WINDOWS windows of each text, evenly over it. Rows with a null text, lang or doc_id teach nothing.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(F.xxhash64("doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    labelled = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("part", F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    # About twice as many as are wanted have a hash below the bound; the rest is not sorted. Rows of one id count as one.
    near = labelled.join(F.broadcast(counts), "lang").where((F.col("part") * F.col("n") < 2 * max_texts + 100) & F.col("text").rlike(r"\p{L}"))  # max_languages rows
    single = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = single.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= max_texts)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = LENGTH + max(WIDTHS) - 1
        for batch in sliced(batches, "text"):
            langs, ids, raws = [], [], []
            for lang, h, t in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), utf8(batch, "text"), strict=True):
                for k, at in enumerate(sorted({int(x) for x in np.linspace(0, max(0, len(t) - LENGTH), TEXT_WINDOWS)})):
                    piece = t[at : at + size]
                    if k % 2:
                        begin = piece.find(b" ") + 1
                        piece = piece[begin : begin + 4 + (h >> 8 * k) % (SHORT - 3)]
                    langs.append(lang)
                    ids.append(h)
                    raws.append(piece.ljust(size, bytes([PAD])))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["lang", "h", "w"])

    rows = least.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, w binary").orderBy("lang", "h", "w").collect()  # windows of max_texts texts a language
    languages = sorted({r["lang"] for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r["w"]) for r in rows), np.uint8).reshape(len(rows), LENGTH + max(WIDTHS) - 1)
    return windows, np.array([number[r["lang"]] for r in rows], np.int64), languages


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS, max_languages: int = MAX_LANGUAGES) -> Network | None:
    """A network trained on sample(); None without a labelled text."""
    windows, labels, languages = sample(docs, max_texts, max_languages)
    return train(windows, labels, languages) if languages else None


def languages_of(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) per row of docs.

    Null texts and texts without a letter are `und` with a score of 0, as is every text where no language was learned. With
    one language learned, all others are of it. Equal scores: the language that comes first in order. Repeated rows come out
    once each, rows with a null id are not held out. Long texts are read whole, window by window. Empty tables give no rows.
    Only doc_id and text are read, and the doc_id serves only the fold.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    (lettered,) = free(["doc_id", "text"], "lettered")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(lettered))
    schema = f"doc_id {docs.select('doc_id').schema[0].dataType.simpleString()}, lang_pred string, score double"
    shared = spark.sparkContext.broadcast(network and pickle.dumps(network))  # filters and a row for each language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", keep=True):
            texts, asked = utf8(batch, "text"), batch.column(lettered).to_pylist()
            some = [k for k, x in enumerate(asked) if x and shared.value]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if some:
                known, now, then = _ready(shared.value)
                best, score = identify(known, [texts[k] for k in some], now, then)
                for k, b, s in zip(some, best.tolist(), score.tolist(), strict=True):
                    names[k], scores[k] = known.languages[b], round(s, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return languages_of(docs, fit(docs))
