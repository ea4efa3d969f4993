"""Fill-in-the-middle against plain Python; the byte network against its definition, its slopes and held-out texts."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import infill as M
from tidemark.llm import language as L

ODD = ["", " ", "\n", "a", " a", "a ", "  a b\t\n c  ", " x y z", "\U0001f600 \U0001f601b \U0001f602", "x\x00y \x0b z", "a<", "<P", "M> a <", "\r\n\r\n a\n\nb\n", "é è́ ß"]


@pytest.mark.parametrize("unit", list(M.UNITS))
def test_borders_cut_what_the_grammar_matches(spark, unit):
    rng = np.random.default_rng(2)
    texts = ODD + ["".join(rng.choice(list("ab \n\t \U0001f600<"), size=n)) for n in range(1, 60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", M.units(df["text"], unit).alias("u")).collect():
        assert r["u"] == re.findall(M.UNITS[unit].grammar, r["text"])


def brute(doc_id, text):
    text = text or ""
    n_units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(n_units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (n_units[:a], n_units[a:b], n_units[b:]))
    return (doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_forms_parts_and_round_trip(spark):
    texts = ODD + ["<P>x y", "a b <S> c", "x<M>", None, "w " * 200_000, "<", "<<<P", "a <S b P> c M>"]
    rows = [(k, t) for k, t in enumerate(texts * 8)] + [(None, "one two three"), (5, "again and again"), (5, "again and again")]
    df = spark.createDataFrame([(i, t, "x", 1, None, "y") for i, t in rows], "doc_id long, text string, form string, n int, digest string, OUTPUT string")
    made = M.fill_in_middle(df)
    assert made.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=repr) == sorted((brute(i, t) for i, t in rows), key=repr)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    back = made.select("output", "form").withColumn("t", M.restored(made["output"], made["form"])).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in rows)


def test_infill_of_an_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def network(rng, languages=3):
    some = len(L.WIDTHS) * L.FILTERS
    return L.Network([f"l{k}" for k in range(languages)], rng.normal(size=(256, L.EMBEDDED)), [rng.normal(size=(w, L.EMBEDDED, L.FILTERS)) for w in L.WIDTHS], rng.normal(size=some), rng.normal(size=(some, languages)) / 10, rng.normal(size=languages))


def test_slopes_match_differences():
    rng = np.random.default_rng(0)
    net = network(rng)
    windows = rng.integers(97, 103, (6, L.LENGTH + max(L.WIDTHS) - 1)).astype(np.uint8)
    labels, weights = rng.integers(0, 3, 6), rng.random(6) + 0.5
    flat = lambda n: [n.embedding, *n.filters, n.bias, n.dense, n.offset]
    _, slopes = L.gradients(net, windows, labels, weights)
    for value, slope in zip(flat(net), slopes, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in value.shape)
            if value is net.embedding:
                at = (int(rng.integers(97, 103)), at[1])
            was, step = value[at], 1e-6
            value[at] = was + step
            up, _ = L.gradients(net, windows, labels, weights)
            value[at] = was - step
            down, _ = L.gradients(net, windows, labels, weights)
            value[at] = was
            assert slope[at] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-7)


def test_tables_answer_like_the_network():
    rng = np.random.default_rng(1)
    net = network(rng)
    texts = [bytes(rng.integers(0, 255, n, dtype=np.uint8)) for n in (1, 3, 122, 123, 125, 126, 250, 4_000, 40_000)]
    raw, windows, held = L.layout(texts)
    assert held.sum() == sum(map(len, texts)) and windows.sum() == len(held)
    rows = np.lib.stride_tricks.sliding_window_view(raw, L.LENGTH + max(L.WIDTHS) - 1)[:: L.LENGTH]
    plain, _ = L.answers(net, rows)
    looked = np.concatenate(list(L.looked_up(net, raw, *L.tables(net))))
    assert np.allclose(looked, plain, atol=1e-4)
    best, score = L.identify(net, texts, *L.tables(net))
    p, at = L.probabilities(net, plain), 0
    for k, (t, w) in enumerate(zip(texts, windows, strict=True)):
        mean = (p[at : at + w] * held[at : at + w, None]).sum(0) / len(t)
        assert best[k] == mean.argmax() and score[k] == pytest.approx(mean.max(), abs=1e-5)
        at += w


WORDS = {"aa": "kato miru sona pelu tari".split(), "bb": "grunz schlaf wicht zapf".split(), "c c": "été où ça près".split()}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    names = list(WORDS)
    return [(k, " ".join(rng.choice(WORDS[names[k % 3]], size=int(rng.integers(3, 200)))), names[k % 3]) for k in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(*r, "x", 1.0) for r in texts(240, 5)] + [(900, None, "aa", "x", 1.0), (901, "kato", None, "x", 1.0), (None, "kato miru", "zz", "x", 1.0), (902, "123 !", "zz", "x", 1.0)] + [(12, "grunz", "bb", "x", 1.0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, score double")
    return docs, L.fit(docs)


def test_held_out_texts_are_told(spark, trained):
    docs, net = trained
    assert net.languages == ["aa", "bb", "c c"]  # ids, texts or letters lack where zz is
    out = L.languages_of(docs, net)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    named = {k: lang for k, _, lang in texts(240, 5)}
    rows = [r for r in out.collect() if r["doc_id"] in named and r["held_out"]]
    assert len(rows) > 30 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == named[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark, trained):
    docs, _ = trained
    spoilt = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(string(doc_id) as binary)), 4) = 2, 'qq', lang) AS lang", "'s' AS source")
    again = L.fit(spoilt)
    assert again.languages == ["aa", "bb", "c c"]
    a, b = (sorted(map(tuple, L.languages_of(x, again).collect()), key=repr) for x in (docs, spoilt))
    assert a == b


def test_odd_texts_and_models(spark, trained):
    _, net = trained
    odd = [(1, None), (2, ""), (3, " 12 \n\t!"), (None, "kato miru sona"), (4, "grunz wicht " * 100_000), (4, "grunz"), (4, "grunz"), (5, "x"), (6, "² ①"), (7, "۱۲")]
    docs = spark.createDataFrame([(i, t, "x", 2, "y") for i, t in odd], "doc_id long, text string, lang_pred string, lettered int, held_out string")
    got = [tuple(r) for r in L.languages_of(docs, net).collect()]
    assert len(got) == len(odd)
    by = {(i, s > 0): p for i, _, p, s in got}
    assert by[1, False] == by[2, False] == by[3, False] == by[6, False] == by[7, False] == "und"
    assert by[4, True] == "bb" and by[None, True] == "aa" and by[5, True] in net.languages
    assert {r[2:] for r in map(tuple, L.languages_of(docs, None).collect())} == {("und", 0.0)}
    one = docs.selectExpr("doc_id", "text", "'only' AS lang")
    alone = L.fit(one)
    assert {r["lang_pred"]: r["score"] for r in L.languages_of(docs, alone).collect()} == {"only": 1.0, "und": 0.0}
    empty = docs.limit(0).selectExpr("doc_id", "text", "'x' AS lang")
    assert L.fit(empty) is None and L.languages_of(empty, None).collect() == []


def test_sample_is_bounded_and_covers_languages(spark):
    docs = spark.createDataFrame(texts(300, 9), "doc_id long, text string, lang string")
    windows, labels, languages = L.sample(docs, max_texts=10, max_languages=2)
    assert len(languages) == 2 and max(np.bincount(labels)) <= 10 * L.TEXT_WINDOWS
    assert windows.shape == (len(labels), L.LENGTH + max(L.WIDTHS) - 1)
