"""Text operators against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, html, quality_model, quality_rules, simhash, substrings, urls, warc

R = random.Random(11)
VOCABULARY = [f"w{k}" for k in range(300)]
PASSAGE = " ".join(R.choice(VOCABULARY) for _ in range(60))


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


TEXTS = [None, "", " \n\t ", "One", "a b c", *[prose(R.randint(1, 90)) for _ in range(25)], PASSAGE, f"{prose(20)} {PASSAGE}\n{prose(10)}", PASSAGE.replace(" ", "\n"), *["copy " + PASSAGE] * 4, "x y " * 60, "ÄÖ É\u00a0b " * 30, prose(4000), "the end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, t, "src", len(t or ""), k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_words long")


@pytest.fixture
def files(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def words(text):
    return (text or "").encode().split()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeated_windows_against_a_plain_count():
    r = random.Random(3)
    for _ in range(60):
        window = r.choice([3, 5, 35])
        segments = [[b"%d" % r.randint(0, r.choice([1, 30])) for _ in range(r.randint(window, window + 90))] for _ in range(r.randint(1, 6))]
        segments.append(segments[0][: max(window, 20)] + [b"z"] + segments[-1])
        counts = Counter(tuple(s[i : i + window]) for s in segments for i in range(len(s) - window + 1))
        for s, flags in zip(segments, substrings.repeated_windows(segments, window), strict=True):
            assert flags.tolist() == [counts[tuple(s[i : i + window])] > 1 for i in range(len(s) - window + 1)]


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substring_dedup(files, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    split = [words(t) for t in TEXTS]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for k, w in enumerate(split):
        gone = {i + j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((k if k % 9 else None, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert rows_of(substrings.repeated_words(files)) == sorted(want, key=str)
    left = substrings.without_repeats(files)
    assert left.columns == files.columns and left.count() == len(TEXTS)
    assert left.where(F.length("text") != F.col("n_chars")).count() == 0
    assert substrings.repeated_words(files.where("doc_id < 0")).count() == 0


def test_fingerprints_and_components(files, spark):
    def plain(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = simhash.near_duplicates(files).collect()
    fps = [plain(t) for t in TEXTS]
    ids = [k if k % 9 else None for k in range(len(TEXTS))]
    root = list(range(len(fps)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {g: min((ids[k] for k in range(len(fps)) if find(k) == g and ids[k] is not None), default=None) for g in map(find, range(len(fps)))}
    want = [(ids[k], f"{fps[k]:016x}", least[find(k)]) for k in range(len(fps))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    shingle = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0] % 2**64
    assert shingle == xxhash.xxh64_intdigest(b"a b c", 42)


def test_chains_of_links_and_dense_clusters(spark):
    """Links against brute force: chains of three bits, a dense cluster around one fingerprint, pairs at just 3 and 4 bits."""
    r = random.Random(8)
    flip = lambda x, bits: x ^ sum(1 << b for b in r.sample(range(64), bits))
    centre = r.getrandbits(64)
    chain = [(1 << k) - 1 for k in range(0, 61, 3)]
    dense = [flip(centre, r.randint(0, 4)) for _ in range(400)]
    pairs = [y for _ in range(60) for x in [r.getrandbits(64)] for y in (x, flip(x, r.choice([3, 4])))]
    values = sorted({x - (x >> 63 << 64) for x in [*chain, *dense, *pairs]})
    root = dict.fromkeys(values)
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3 and find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    df = spark.createDataFrame([(x,) for x in values], "fp long")
    assert {r.fp: r.root for r in simhash.linked(df).collect()} == {x: find(x) for x in values}
    close = simhash.close_links(df)
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in close.collect())
    assert simhash.linked(df.limit(0)).count() == 0
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, tmp_path):
    r = random.Random(5)
    base = [prose(200, r) for _ in range(6)]
    near = [b.replace(" " + b.split()[50] + " ", " changed ", 1) for b in base]
    rows = [(k % 5, t) for k, t in enumerate([*base, *near, *base, None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = simhash.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(kept) == 7 and sorted(t.text for t in kept if t.text) == sorted(base)


def test_contamination(files, spark):
    items = [(1, PASSAGE), (2, "w1"), (3, None), (4, ""), (5, "x Y x y x y x y x y x y x y"), (None, "one"), (10, prose(30)), (10, "ONE"), (7, "é É b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    want = []
    for k, text in enumerate(TEXTS):
        w, hit, found = fold(text), set(), set()
        for name, item in items:
            v = fold(item)
            size = min(13, len(v))
            for s in range(len(v) - size + 1 if v else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == v[s : s + size]:
                        hit |= set(range(i, i + size))
                        found.add(name)
        want.append((k if k % 9 else None, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert rows_of(decontaminate.contamination(files, bench)) == sorted(want, key=str)
    assert rows_of(decontaminate.contamination(files, bench, block_bytes=200)) == sorted(want, key=str)
    kept = decontaminate.contamination(files, bench, flag="_contaminated")
    assert kept.columns == [*files.columns, "_contaminated"] and kept.where("_contaminated").count() == sum(x[-1] for x in want)
    assert decontaminate.contamination(files, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_quality_counts(files):
    want = {}
    for k, text in enumerate(TEXTS):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[k] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
    got = quality_rules.judge(files).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want.values())
    assert not any(r.kept and r.base_failed for r in got)


def test_lines_that_fail_go_and_documents_that_lose_too_much(spark):
    good = "This is a line of plain prose that ends as a sentence does."
    other = "Another line of the same kind, with words enough for a document."
    cases = {f"{good}\n{other}": f"{good}\n{other}", f"{good}\nHome | News | About\n{other}\nread our privacy policy\nSHOUTING ALL THE TIME.\nshort title": f"{good}\n{other}", "a### b### c### d### e### f### g### h### i### j### k###": None, "Home | A | B | C | D | E | F\n" + good[:30]: None}
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.clean(df).collect()}
    assert got == {k: (t, len(t)) for k, t in enumerate(cases.values()) if t is not None}


def test_classifier_learns_rules_and_scores_held_out_rows(spark):
    r = random.Random(6)
    kinds = [lambda: prose(80, r) + ".", lambda: " ".join(w + "###" for w in prose(80, r).split()), lambda: "same " * 60]
    rows = [(k, kinds[0]() if k % 3 else kinds[1 + k % 2](), int(k % 3 > 0)) for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, None), (-1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    got = quality_model.score(df, labels).collect()
    truth = {k: q for k, _, q in rows}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == 602 and 80 < len(held) < 160 and all(0 <= x.score <= 1 for x in got)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    assert {x.score for x in quality_model.score(df, labels.limit(0)).collect()} == {0.5}


def test_statistics_and_scores_against_plain_python(spark, files):
    """The statistics of each text and the score of a compiled model, worked out again without Spark."""

    def plain(text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        per = lambda a, b: a / b if b else 0.0
        share = lambda characters: per(sum(c in characters for c in t), len(t))
        ends = re.compile(quality_rules.ENDS_SENTENCE.replace("*$", "*\\Z"))
        return [
            float(len(w)), per(len(set(w)), len(w)), per(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), per(sum(len(x) > 14 for x in w), len(w)),
            float(len(lines)), per(len(set(lines)), len(lines)), per(sum(bool(ends.search(x)) for x in lines), len(lines)), float(len(t)),
            share("#*$%&<>"), share("|"), share("!?"), share(".,;:"), share("0123456789"), share(" \t\n\x0b\x0c\r"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ]

    extra = ["Ends. \nDoes not\n|a| 12!?", "a a  a verylongwordoffifteen\x0b\x0cB", "“Quoted.”\nsame\nsame\n \n", "word " * 30_000]
    rows = [(k, t) for k, t in enumerate([*TEXTS, *extra])] + [(0, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    model = (0.25, [(1.5, (("w.n_words", ">", 3.0), ("symbols", "<=", 0.1))), (-0.75, (("l.distinct_lines", "<=", 0.9),)), (2.0, (("digits", ">", 0.0), ("w.distinct", "<=", 0.5)))])
    text = F.coalesce(F.col("text"), F.lit(""))
    got = df.select("doc_id", "text", quality_model.statistics(text).alias("s")).select("text", *[F.col(f"s.{n}").alias(n.replace(".", "_")) for n in quality_model.NAMES], quality_model.compile_score("s", *model).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r.text)
        assert list(r[1:-1]) == pytest.approx(want), r.text
        x = np.array([want])
        total = model[0] + sum(c for c, rule in model[1] if quality_model.holds(rule, x)[0])
        assert r.p == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality_model.score(df.limit(0), df.select("doc_id", F.lit(1).alias("quality"))).count() == 0


def test_a_fit_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(9)
    rows = [(k % 150, (prose(30, r) + ".") if k % 3 else "##" * 30) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(150)] * 2 + [(7, 0)], "doc_id long, quality int")
    a = quality_model.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    b = quality_model.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), labels.repartition(3))
    assert a == b and a[1]


def test_url_rules(spark):
    cases = {
        "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "x://example.com/de?a": ("example.com", "/de", "com/", "allow"), "http://com": ("com", "", None, "allow"), "http://a.net/fr/1#x": ("a.net", "/fr/1", "net/fr/", "block"), "http://notnet/fr/": ("notnet", "/fr/", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://org/x://y.com/": ("org", "/x://y.com/", None, "allow"), "http://a.b.c.d.example.com/en/" + "z" * 3000: ("a.b.c.d.example.com", "/en/" + "z" * 3000, "example.com/en/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = urls.filter_urls(pages, urls.RULES)
    assert rows_of(got) == sorted([(k, *v) for k, v in enumerate(cases.values())] * 2, key=str)
    table = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert rows_of(urls.filter_urls(pages, table)) == rows_of(got)
    assert {r.verdict for r in urls.filter_urls(pages, [], default="block").collect()} == {"block"}
    assert urls.filter_urls(pages.limit(0), urls.RULES).count() == 0


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><!-- no --><main class="with-sidebar"><h1>A &amp; B</h1><p>One <b>t</b>wo\n three&nbsp;four.</p><div class="ad">buy</div><form><input>Name</form><p>Five<br>six</p><section id="comments"><p>nice post, many words, really very many words</p></section></main><div class="cookie-notice">We use</div><script>x("</p>")</script><footer>c</footer></body></html>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p class='notice'>Note<p>One two three<p>Four</article>", "One two three\nFour"),
        ("<nav>Menu<article><p>One two<div class=ad>Buy</article><div>Tail text</div>", "One two"),
        ("<div class='sidebar-right'><article><p>Main text here</article></div><div class=comments><article>nice one</article></div>", "Main text here"),
        ("<div class='site-header'>Site name here</div><article><header><h1>T</h1></header><p>Text of it</p></article>", "T\nText of it"),
        ("<div class='post-header has-sidebar'><h1>Title</h1></div><p>Some text &#8212; and more.</p>", "Title\nSome text \u2014 and more."),
        ("<ul class='breadcrumbs'><li>a<li>b</ul><table><tr><td>One</td><td>two words</td></tr></table><div id='comments'><p>hi there you</p></div>", "One\ntwo words"),
    ],
)
def test_pages_that_are_not_tidy(page, want):
    assert html.main_text(page, {}) == want


def test_main_text(spark):
    pages = spark.createDataFrame([(k, "u", t) for k, t in enumerate([PAGE, None, "", "plain &lt;text&gt;", PAGE, "<p>unclosed <b>words", "<div>" * 2000 + "deep" + "</div>" * 10])], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    want = "A & B\nOne two three four.\nFive six"
    assert got[0] == got[4] == (want, len(want))
    assert got[1] == got[2] == ("", 0) and got[3][0] == "plain <text>" and got[5][0] == "unclosed words" and got[6][0] == "deep"
    assert html.extract(pages.limit(0)).count() == 0
    assert html.weights_from({("p", True): 50, ("div", False): 50})["div"] > html.weights_from({("p", True): 50})["p"]


def test_fixity(spark, tmp_path):
    """Against a plain audit: digests, lengths and statuses of records that were changed, lost, or moved by a lost one."""
    rows = [(k if k % 50 else None, f"http://h/{k}", "<p>" + "x" * (k % 700) + "é</p>") for k in range(400)] + [(5, None, None)] * 2 + [(900, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrest")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p")).withColumn("row", F.lit(7)).withColumn("record", F.lit("x"))
    source = warc.materialize(warc.records(pages.select("page_id", "url", "html")), "s")
    table = warc.materialize(warc.leaves(source), "t")
    held = {r.record_id: r for r in table.collect()}
    assert len(held) == len(rows)
    texts = {hashlib.sha256(r.record.encode()).hexdigest(): r.record for r in source.collect()}
    for r in held.values():
        text = texts[r.digest].encode()
        assert r.length == len(text) and r.record_id.encode() in text and b"WARC-Date: " in text
    warc.write_segments(source, str(tmp_path / "same"))
    back = warc.read_records(spark, str(tmp_path / "same"))
    assert back.where("not intact").count() == 0
    assert {(r.record_id, r.segment, r.offset, r.length, r.digest) for r in back.collect()} == {(r.record_id, r.segment, r.offset, r.length, r.digest) for r in held.values()}
    assert rows_of(back.select(F.col("page_id").cast("long"), "url", "html")) == sorted([(i, u or "", h or "") for i, u, h in rows], key=str)
    assert warc.audit(table, back).count() == 0
    got = {r.page_id: r for r in warc.fixity(pages).where("page_id is not null and page_id <> 5").collect()}
    crc = lambda i: zlib.crc32(str(i).encode()) % 97
    for i, r in got.items():
        assert r.status == "missing" if crc(i) == 11 else r.status == "altered" if crc(i) == 5 else r.status in ("intact", "moved")
        text = texts[r.primary_sha256]
        want = None if crc(i) == 11 else hashlib.sha256((text[:-6] + "??\r\n\r\n").encode()).hexdigest() if crc(i) == 5 else r.primary_sha256
        assert r.replica_sha256 == want
    assert {r.status for r in got.values()} == {"missing", "altered", "intact", "moved"} or len({r.status for r in got.values()}) >= 3
    assert warc.fixity(pages).count() == len(rows) and warc.fixity(pages.limit(0)).count() == 0
    few = table.where("page_id is null or page_id <> 77")
    assert {r.status for r in warc.audit(few, table).collect()} <= {"extra", "moved"} and warc.audit(few, table).where("status = 'extra'").count() == 1


def test_a_spoilt_replica_is_paired_record_by_record(spark):
    """Records that stand twice or three times, in another order, relabelled, with a torn id, altered where they are or elsewhere."""
    p = [(100 * k, f"<{k}>", f"d{k}") for k in range(12)]
    r = [
        (0, "<0>", "d0"), (50, "<0>", "d0"), (60, "<0>", "d0"),  # three times, the first in place
        (100, "<1>", "x1"),  # altered in place
        (200, None, "x2"), (300, "<7>", "x3"),  # no id any more, and another's
        (400, "<5>", "d5"), (500, "<4>", "d4"),  # changed places
        (650, "<6>", "x6"),  # altered elsewhere
        (700, "<7>", "d7"), (900, "<99>", "new"), (1100, "<11>", "d11"),
    ]
    got = {(s, a and a[0], b and b[0]) for s, a, b in warc.paired(p, r)}
    assert got == {
        ("intact", 0, 0), ("extra", None, 50), ("extra", None, 60), ("altered", 100, 100), ("altered", 200, 200), ("altered", 300, 300), ("moved", 400, 500), ("moved", 500, 400),
        ("altered", 600, 650), ("intact", 700, 700), ("missing", 800, None), ("altered", 900, 900), ("missing", 1000, None), ("intact", 1100, 1100),
    }
    schema = "segment int, offset long, record_id string, digest string"
    tables = [spark.createDataFrame([(3, *x) for x in t], schema) for t in (p, r)]
    found = warc.audit(*tables).collect()
    assert {(x.status, x.primary_sha256 and x.offset, x.replica_offset) for x in found} == {x for x in got if x[0] != "intact"}
    doubled = lambda records: records.unionByName(records.where("page_id = 3")).unionByName(records.where("page_id = 4").withColumn("row", F.lit(10**6))).unionByName(records.where("page_id = 4").withColumn("row", F.lit(10**6)))
    pages = spark.createDataFrame([(k, f"u{k}", "h" * k) for k in range(9)] + [(9, "u", "z" * 30_000)], "page_id long, url string, html string")
    rows = warc.fixity(pages, doubled).collect()
    assert len(rows) == 13 and sorted(x.page_id for x in rows if x.page_id is not None) == list(range(10))
    assert {x.status for x in rows if x.page_id is not None} <= {"intact", "moved"} and [x.status for x in rows if x.page_id is None] == ["extra"] * 3


def test_trees_against_plain_digests(spark):
    table = spark.createDataFrame([(0, o, f"d{o}") for o in (0, 10, 70_000, 70_010, 2_000_000)], "segment int, offset long, digest string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    low, mid, high = ([tuple(r) for r in level.orderBy("node").collect()] for level in warc.tree(table, 3))
    nodes = {0: sha("0 d0\n10 d10"), 1: sha("70000 d70000\n70010 d70010"), 30: sha("2000000 d2000000")}
    assert low == [(0, k, d) for k, d in nodes.items()]
    above = {0: sha(f"0 {nodes[0]}\n1 {nodes[1]}"), 1: sha(f"30 {nodes[30]}")}
    assert mid == [(0, k, d) for k, d in above.items()] and high == [(0, 0, sha(f"0 {above[0]}\n1 {above[1]}"))]


def test_torn_records_are_passed_over():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for torn in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\nab\r\n\r\n", b"junk\r\n\r\n", b"WARC/1.1\r\n\r\n\r\n"):
        found = list(warc.framed(good + torn + good))
        assert [f[2] is not None for f in found][0] and found[-1][3] == b"ab" and sum(f[1] for f in found) == 2 * len(good) + len(torn)
    assert list(warc.framed(b"")) == []


def test_stretches_against_each_window(monkeypatch):
    r = random.Random(13)
    for _ in range(40):
        window = r.choice([3, 9, 35])
        gram = min(substrings.GRAM, window)
        texts = [[b"%d" % r.randint(0, r.choice([1, 40])) for _ in range(r.choice([0, 1, window - 1, window, r.randint(window, 200)]))] for _ in range(6)]
        got = {}
        for k, start, size, marker, weight in zip(*(x.tolist() for x in substrings.stretches(texts, window)), strict=True):
            for i in range(start, start + size):
                assert (k, i) not in got
                got[k, i] = marker
            g = substrings.grams(substrings.word_hashes(texts[k][start : start + size + window - 1]), gram).tolist()
            assert weight == 1 + (g.count(marker) > 1)
        want = {}
        for k, t in enumerate(texts):
            for i in range(len(t) - window + 1):
                want[k, i] = min(substrings.grams(substrings.word_hashes(t[i : i + window]), gram).tolist())
        assert got == want


@pytest.mark.parametrize(("hot", "held"), [(3, 16 << 20), (3, 100)])
def test_a_common_passage_in_many_contexts(spark, tmp_path, monkeypatch, hot, held):
    """Markers over HOT places: contents that differ at their ends only, near copies, and copies, in many tasks."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    r = random.Random(14)
    base = prose(150, r).split()
    texts = [f"{prose(r.randint(0, 50), r)} {PASSAGE} {prose(r.randint(0, 50), r)}" for _ in range(60)] + [" ".join(base)] * 8
    for _ in range(40):
        w = list(base)
        w[r.randrange(150)] = "edit%d" % r.randrange(12)
        texts.append(" ".join(w))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    split = [words(t) for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = {}
    for k, w in enumerate(split):
        gone = {i + j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    got = substrings.repeated_words(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == want


def test_rows_are_numbered_the_same_however_they_are_read(files, docs, spark):
    for table in (files, files.where("n_chars > 3"), docs.repartition(5)):
        rows = common.numbered(table, "r")
        first = sorted(rows.select("r", "text", "n_words").collect(), key=str)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        again = sorted(rows.repartition(3).select("r", "text", "n_words").collect(), key=str)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert first == again and len({x.r for x in first}) == len(first) == table.count()
    assert common.free(["_Row", "row"], "row", "other") == ["__row", "other"]


def test_columns_may_be_called_like_those_that_operators_use(files):
    names = ["row", "_row", "rest", "words", "kept", "sha", "spots", "_kept", "_m", "_l", "_base_failed", "_contaminated", "path", "file", "index", "id", "s", "_words", "covered", "_covered", "_items"]
    wide = files.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for operator in (substrings.without_repeats, simhash.one_of_each, quality_rules.clean):
        out = operator(wide)
        assert out.columns == wide.columns
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]
        assert rows_of(out.select("doc_id", "text", "n_chars")) == rows_of(operator(files).select("doc_id", "text", "n_chars"))
