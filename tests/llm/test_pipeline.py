"""The pipeline against plain Python stage by stage, on a small folder of tables."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

R = random.Random(21)
VOCABULARY = [f"word{k}" for k in range(2000)]


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


BENCH = [sentence(20) for _ in range(3)]
SHARED = sentence(60)
CLEAN = ["\n".join(sentence(12) for _ in range(12)) for _ in range(8)]
TEXTS = [
    *CLEAN,
    CLEAN[0],  # a copy
    CLEAN[1].replace(CLEAN[1].split()[70], "other", 1),  # a near copy
    *[f"{sentence(40)}\n{SHARED}\n{sentence(40)}" for _ in range(2)],  # a shared passage
    f"{sentence(30)}\n{BENCH[0]}",  # benchmark text
    "Home | News | About | Contact | Help | More | Login | Search | Map | Top",
    " ".join(w + "###" for w in sentence(40).split()),
    "same words " * 40,
    None,
    "",
    "Too short.",
    CLEAN[2] + "\nHome | News",  # loses a line and then is a near copy
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_each_stage_does_its_work_and_keeps_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.orderBy("doc_id").collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        seen.append(docs.orderBy("doc_id").collect())
    ids = [[r.doc_id for r in rows] for rows in seen]
    assert ids[1] == [*range(13), 19]
    assert {r.doc_id: r.text for r in seen[1]}[19] == CLEAN[2]
    assert ids[2] == [*range(8), 10, 11, 12]
    texts = [r.text for r in seen[2]]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    for before, w, after in zip(texts, split, [r.text for r in seen[3]], strict=True):
        gone = {i + j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        assert after == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else before)
    assert SHARED not in " ".join(r.text for r in seen[3])
    assert ids[4] == [*range(8), 10, 11]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted({r.doc_id for r in packed}) == ids[4]
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_columns_of_the_documents_may_have_any_names(spark, folder, tmp_path):
    extra = ["contaminated", "spots", "spans", "fp", "root", "size", "marker", "key", "kept", "id", "start", "hot", "n_words", "component_id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
    assert docs.columns[-len(extra) :] == extra and [r.doc_id for r in docs.orderBy("doc_id").collect()] == [*range(8), 10, 11]
    assert docs.select(*extra).distinct().count() == 1


def test_an_empty_corpus_goes_through(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
