import random
import time
import zlib

import numpy as np
import pytest
from tidemark.llm.packing import best_fit, bin_completion, lower_bound, pack
from tidemark.llm.tokens import ChunkEncoder, PrefixCounter, default_vocabulary, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["a", "aa", "b", " ", "  ", "\n", "\n ", "'s", "'re", "'", "é", "日本", "1", "23", "!!", "$$$", "<|endoftext|>", "\t", "\xa0", "ing", " the", "\r\n", "😀", "'LL", "'ll"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_prefix_counts_are_those_of_each_prefix_encoded_alone(library):
    counter = PrefixCounter(default_vocabulary())
    for text in odd_texts(400, 5):
        assert counter.count(text) == len(ids(library, text))
        if "<|" in text:
            continue
        raw, counts = text.encode(), counter.prefix_counts(text)
        for i in range(1, len(raw) + 1):
            if i == len(raw) or raw[i] & 0xC0 != 0x80:
                assert counts[i - 1] == len(ids(library, raw[:i].decode())), (text, i)


def test_token_counts_of_rows(spark, library):
    texts = [*odd_texts(60, 6), None, "", "word " * 3000, "x" * 5000, "same", "same"]
    df = spark.createDataFrame([(k if k % 7 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    rows = token_counts(df, limit=5).collect()
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()), len(ids(library, t or ""))) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 5) and (r.over_limit or r.cut_bytes == r.n_bytes) for r in rows)
    assert token_counts(df.limit(0)).count() == 0


def test_bin_completion_is_exact_on_small_cases():
    def least(items, capacity):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity:
                    bins[i] += items[k]
                    place(k + 1, bins)
                    bins[i] -= items[k]
            bins.append(items[k])
            place(k + 1, bins)
            bins.pop()

        place(0, [])
        return best

    r = random.Random(2)
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        counts = {x: items.count(x) for x in items}
        plan = bin_completion(counts, 20, None)
        used = {}
        for filling, times in plan:
            assert sum(x * n for x, n in filling) <= 20
            for x, n in filling:
                used[x] = used.get(x, 0) + n * times
        assert used == counts
        assert lower_bound(counts, 20) <= sum(t for _, t in plan) == least(items, 20)
    assert bin_completion({}, 20) == []


def test_the_search_does_better_than_best_fit_within_its_steps():
    r = random.Random(0)
    counts = {}
    for _ in range(2000):
        x = r.randint(500, 1100)
        counts[x] = counts.get(x, 0) + 1
    sequences = lambda plan: sum(n for _, n in plan)
    found = bin_completion(counts, 2048)
    assert lower_bound(counts, 2048) <= sequences(found) < sequences(best_fit(counts, 2048))
    assert sequences(bin_completion(counts, 2048, 0)) == sequences(best_fit(counts, 2048))
    # many ones: fillings of thousands of pieces are no deeper than their different lengths
    assert sequences(bin_completion({1: 5000, 700: 3, 2000: 2}, 2048)) == lower_bound({1: 5000, 700: 3, 2000: 2}, 2048)


def test_characters_of_other_unicode_versions_and_long_words_count_as_in_the_library(library):
    counter = PrefixCounter(default_vocabulary())
    r = random.Random(4)
    ranges = [(0xA0, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x11FFF), (0x18D00, 0x18FFF), (0x2E000, 0x32400), (0x1E000, 0x1F000), (0xE0000, 0xE0200)]
    for _ in range(1500):
        text = "".join(chr(r.randint(*r.choice(ranges))) if r.random() < 0.6 else r.choice(ODD) for _ in range(r.randint(1, 8)))
        assert counter.count(text) == len(ids(library, text)), ascii(text)
    for text in ["ab" * 40_000, "".join(r.choice("thenaiogr") for _ in range(60_000)), "!" * 5000 + "é" * 5000]:
        began = time.time()
        assert counter.count(text) == len(ids(library, text))
        assert time.time() - began < 3


def test_remembered_chunks_give_the_ids_of_the_library(library):
    r = random.Random(12)
    words = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["it's", "12", "3.5", "日本", "a\tb", "\U00018e5a", "<|endoftext|>", "x<|endoftext|>"]
    texts = []
    for _ in range(600):
        texts.append("".join(r.choice(words) + r.choice([" ", " ", " ", "\n", ", ", ".\n", "\n\n", " \n", "\n ", "\n\n\n", "  ", "\r\n", ""]) for _ in range(r.randint(1, 12))))
    held = ChunkEncoder(default_vocabulary())
    for at in range(0, len(texts), 50):
        got = [list(np.frombuffer(x, "<u4")) for x in held.ids(texts[at : at + 50])]
        for text, x in zip(texts[at : at + 50], got, strict=True):
            assert x == ids(library, text), ascii(text)
    counter = PrefixCounter(default_vocabulary())
    for text in texts:
        n, cut = counter.measure(text, 7)
        assert n == len(ids(library, text))
        raw = text.encode()
        fits = [i for i in range(len(raw) + 1) if (i == len(raw) or raw[i] & 0xC0 != 0x80) and len(ids(library, raw[:i].decode())) <= 7]
        assert "<|" in text or cut == fits[-1] or n <= 7, (ascii(text), cut, fits[-1])


def test_packed_pieces_restore_every_document(spark, library):
    r = random.Random(8)
    texts = [" ".join(r.choice(["the", "in", "and", "thtion"]) for _ in range(r.randint(0, 300))) for _ in range(120)] + [None, "", "the " * 1500, "same", "same", *odd_texts(20, 9)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, sequence_id string")
    rows = [x.asDict() for x in pack(df, capacity=256).collect()]
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sorted(by_doc) == list(range(len(texts)))
    for k, text in enumerate(texts):
        want, at = [*ids(library, text or ""), 0], 0
        parts = sorted(by_doc[k], key=lambda x: x["piece"])
        assert [x["piece"] for x in parts] == list(range(len(parts)))
        assert len(parts) == 1 or all(x["length"] == 256 for x in parts[1:])
        for x in parts:
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(np.array(want[at : at + x["length"]], "<u4").tobytes())
            at += x["length"]
        assert at == len(want)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by_sequence) <= -(-sum(x["length"] for x in rows) // 256) + 1
    assert pack(df.limit(0)).count() == 0
