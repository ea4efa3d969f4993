"""The near-dedup stage against exact five-word similarity."""

import random

import pytest

from tidemark.llm import simhash

WORDS = [f"w{k}" for k in range(5000)]


def words(n, r):
    return [r.choice(WORDS) for _ in range(n)]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(x, y):
    return len(x & y) / len(x | y)


def kept(spark, texts, path):
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(path))
    return {r.doc_id for r in simhash.one_of_each(spark.read.parquet(str(path))).collect()}


def wanted(texts):
    """One row of each group that links of 0.8 and more make, by brute force: the first."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b in range(len(texts)):
        for a in range(b):
            if find(a) != find(b) and similarity(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in range(len(texts)) if find(k) == k}


def family(r, members, shared, own):
    template = words(shared, r)
    return [[*template, *words(own, r)] for _ in range(members)]


def test_a_template_family_below_the_threshold_stays_whole(spark, tmp_path):
    r = random.Random(1)
    texts = family(r, 60, 240, 40)  # pairwise 236 of 316 shingles: 0.747
    assert 0.7 < similarity(shingles(texts[0]), shingles(texts[1])) < 0.8
    assert kept(spark, texts, tmp_path / "d") == set(range(60))


def test_block_edits_down_to_the_threshold_are_all_found(spark, tmp_path):
    r = random.Random(2)
    texts = []
    for _ in range(60):
        w = words(400, r)
        texts += [w, [*w[:170], *words(r.randrange(15, 42), r), *w[200:]], [*w, *words(r.randrange(40, 110), r)]]
    want = wanted(texts)
    assert kept(spark, texts, tmp_path / "d") == want and 60 <= len(want) < 120


@pytest.mark.parametrize("own", [70, 130])
def test_pairs_inside_a_family_are_found_behind_its_least_row(spark, tmp_path, own):
    r = random.Random(3)
    texts = family(r, 120, 240, own)
    for k in range(0, 40, 2):  # planted pairs; the rest of the family is below the threshold
        texts[k + 1] = [*texts[k][:-12], *words(12, r)]
    want = wanted(texts)
    assert kept(spark, texts, tmp_path / "d") == want and len(want) == 100


def test_strangers_and_chains_in_a_large_group(spark, tmp_path):
    r = random.Random(4)
    base, texts = words(300, r), []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 16)):
            w[r.randrange(300)] = r.choice(WORDS)
        texts.append(w)
    assert kept(spark, texts, tmp_path / "d") == wanted(texts)


def test_near_copies_in_many_small_files_of_one_task(spark, tmp_path):
    r, texts = random.Random(5), []
    for _ in range(40):
        w = words(120, r)
        texts += [w, [*w[:-8], *words(8, r)], list(w)]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = spark.createDataFrame([(k, " ".join(texts[k])) for k in order], "doc_id long, text string").repartition(24)
    rows.write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # several files to a task
    try:
        docs = spark.read.parquet(str(tmp_path / "d"))
        assert docs.rdd.getNumPartitions() < 12
        stay = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(k // 3 for k in stay) == list(range(40))
