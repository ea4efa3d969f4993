"""Quality classifier: a sparse ensemble of rules.

Shallow trees over text statistics are grown on bounded labelled rows; each path from a root becomes a conjunctive rule;
a logistic model with lasso weights keeps few of the rules; these are compiled into one Spark column expression, so that
scoring is a projection over whole texts with built-in functions alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, read
from tidemark.llm.quality_rules import ENDS_SENTENCE, count_of, words_of

#: Labelled rows that the fit uses at most: those with the smallest hashes of their ids.
MAX_ROWS = 12_000
TREES, DEPTH, BINS = 24, 3, 24
#: Lasso penalties tried; the one with the least loss on a fifth of the fitted rows is used.
PENALTIES = (0.0003, 0.001, 0.003)
#: Folds by crc32 of the doc_id as text; rows of fold 0 are held out.
FOLDS = 5
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), all of which must hold


def statistics(text: Column) -> Column:
    """A struct of statistics of a whole text; each is defined for every text, the empty one included."""
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        again = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
        return F.struct(
            n.cast("double").alias("n_words"),
            per(F.size(F.array_distinct(w)), n).alias("distinct"),
            per(again, n).alias("adjacent"),
            per(F.size(F.filter(w, lambda x: F.length(x) > 14)), n).alias("long_words"),
        )

    n = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    of_lines = lambda x: F.struct(
        F.size(x).cast("double").alias("n_lines"),
        per(F.size(F.array_distinct(x)), F.size(x)).alias("distinct_lines"),
        per(F.size(F.filter(x, lambda y: y.rlike(ENDS_SENTENCE))), F.size(x)).alias("sentence_lines"),
    )
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        n.cast("double").alias("n_chars"),
        per(count_of(text, "#*$%&<>"), n).alias("symbols"),
        per(count_of(text, "|"), n).alias("bars"),
        per(count_of(text, "!?"), n).alias("shouts"),
        per(count_of(text, ".,;:"), n).alias("points"),
        per(count_of(text, "0123456789"), n).alias("digits"),
        per(count_of(text, " \t\n\x0b\x0c\r"), n).alias("blanks"),
        per(count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n).alias("capitals"),
    )


NAMES = ["w.n_words", "w.distinct", "w.adjacent", "w.long_words", "l.n_lines", "l.distinct_lines", "l.sentence_lines", "n_chars", "symbols", "bars", "shouts", "points", "digits", "blanks", "capitals"]


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, edges: list[np.ndarray], depth: int, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """Rules of one tree: the path to every node but the root. y: residuals; splits lower their weighted squares most."""
    rules = [path] if path else []
    if depth == 0 or len(y) < 20:
        return rules
    best, cut = 1e-9, None
    for j in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        if not len(edges[j]):
            continue
        at = np.searchsorted(edges[j], x[:, j], "left")  # bin k holds values up to edges[k]
        w = np.bincount(at, weight, len(edges[j]) + 1).cumsum()
        s = np.bincount(at, weight * y, len(edges[j]) + 1).cumsum()
        n = np.bincount(at, minlength=len(edges[j]) + 1).cumsum()
        w0, s0, n0 = w[:-1], s[:-1], n[:-1]
        ok = (n0 >= 5) & (n[-1] - n0 >= 5)
        gain = np.where(ok, s0**2 / np.maximum(w0, 1e-12) + (s[-1] - s0) ** 2 / np.maximum(w[-1] - w0, 1e-12) - s[-1] ** 2 / w[-1], 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, cut = gain[k], (int(j), float(edges[j][k]))
    if cut is None:
        return rules
    j, bound = cut
    low = x[:, j] <= bound
    for side, sign in ((low, "<="), (~low, ">")):
        rules += grow(x[side], y[side], weight[side], edges, depth - 1, rng, (*path, (NAMES[j], sign, bound)))
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, bound in rule:
        v = x[:, NAMES.index(name)]
        out &= v <= bound if sign == "<=" else v > bound
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the intercept goes unpunished."""
    n, k = z.shape
    a = np.c_[np.ones(n), z]
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -35, 35))) - y) / n
        u = v - rate * g
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = u + (before - 1) / t * (u - w)
        w = u
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules; without both labels, an even score."""
    if len(y) < 20 or y.min() == y.max():
        return 0.0, []
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    raw, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        some = rng.choice(len(y), size=max(20, len(y) // 2), replace=False)
        p = 1 / (1 + np.exp(-raw))
        grown = grow(x[some], (y - p)[some] / np.maximum(p * (1 - p), 1e-3)[some], np.maximum(p * (1 - p), 1e-3)[some], edges, DEPTH, rng)
        leaves = [r for r in grown if not any(len(q) > len(r) and q[: len(r)] == r for q in grown)]
        for leaf in leaves:
            m = holds(leaf, x)
            raw += 0.3 * m * np.clip((y - p)[m].sum() / max((p * (1 - p))[m].sum(), 1e-3), -3, 3)
        rules |= dict.fromkeys(tuple(sorted(r)) for r in grown)
    kept, z, seen = [], [], set()
    for r in rules:
        m = holds(r, x)
        if 0 < m.sum() < len(y) and (key := m.tobytes()) not in seen and (~m).tobytes() not in seen:
            seen.add(key)
            kept.append(r)
            z.append(m)
    if not kept:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    z = np.array(z, float).T
    test = rng.random(len(y)) < 0.2
    loss = {}
    for penalty in PENALTIES:
        b, w = lasso(z[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + z[test] @ w))), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)) if test.any() else 0
    b, w = lasso(z, y, min(loss, key=loss.get))
    return b, [(float(c), r) for c, r in zip(w, kept, strict=True) if abs(c) > 1e-4]


def compile_score(stats: str, intercept: float, weighted: list[tuple[float, Rule]]) -> Column:
    """The model as a column expression over the struct named stats."""

    def condition(rule: Rule) -> Column:
        parts = [F.col(f"{stats}.{name}") <= bound if sign == "<=" else F.col(f"{stats}.{name}") > bound for name, sign, bound in rule]
        return reduce(lambda a, b: a & b, parts)

    total = reduce(lambda a, b: a + b, [F.when(condition(r), F.lit(c)).otherwise(F.lit(0.0)) for c, r in weighted], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[float, list[tuple[float, Rule]]]:
    """Fits on at most max_rows labelled rows outside the held-out fold. Rows with a null id or label teach nothing; of
    several rows with one doc_id, the one with the least text (then label) is used, so that fits can be repeated."""
    some = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "quality").limit(max_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # max_rows short rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r")).select("doc_id", "r.*")
    rows = rows.withColumn("_s", statistics(F.col("text"))).select("quality", "doc_id", *[F.col(f"_s.{n}") for n in NAMES]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([[float(v) for v in r[2:]] for r in rows]).reshape(len(rows), len(NAMES))
    return fit_rules(x, np.array([r[0] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    Null texts score as empty ones, long ones are scored whole. Repeated rows are scored once each; rows with a null id are not held out. With no
    labels, or labels of one kind, all scores are 0.5. Empty tables give no rows. Only doc_id and text are read, and the
    doc_id serves only the fold.
    """
    intercept, weighted = fit(docs, labels, max_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scored = docs.select("doc_id", statistics(text).alias("_s")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_score("_s", intercept, weighted).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_model(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
