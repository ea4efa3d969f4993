"""Benchmark items without an id."""

import hashlib

import corpus_pipeline
import pytest

from tidemark.llm import decontaminate


@pytest.mark.parametrize("blocks", [False, True])
def test_items_without_an_id_contaminate_documents_of_the_pipeline(spark, tmp_path, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(decontaminate.contamination, "__defaults__", (13, 20, "", 40))
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(None, item), (None, None), (4, "other words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert found == {1: (20, 1, none, True), 2: (0, 0, none, False), 3: (0, 0, none, False)}


def test_blocks_number_rows_once_and_leave_clashing_columns_alone(spark):
    """Rows of an input whose order is not fixed, with columns named like the operator's own."""
    items = [(k, " ".join(f"w{k}x{i}" for i in range(15))) for k in range(6)]
    texts = {d: (items[d % 6][1] if d % 3 == 0 else f"clean words of {d}") for d in range(40)} | {98: None, 99: ""}
    docs = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in texts.items()], "doc_id long, text string, _row string, row string, covered string, items string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench, flag="_flag", block_bytes=150).collect()
    assert {r.doc_id: r["_flag"] for r in out} == {d: d % 3 == 0 and d < 40 for d in texts}
    assert {(r["_row"], r["row"], r["covered"], r["items"]) for r in out} == {("a", "b", "c", "d")} and len(out) == len(texts)
