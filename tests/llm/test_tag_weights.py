"""Tag weights with many element names."""

import random
import re
import time
from collections import Counter

import pytest

from tidemark.llm import html


def test_every_name_of_the_labelled_pages_keeps_both_its_counts(spark):
    names = [f"x-{k}" for k in range(1200)]
    page = "<body>" + "".join(f"<{n}>a</{n}>" for n in names) + "<article>" + "".join(f"<{n}>b</{n}>" for n in names) + "</article></body>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert html.learn_weights(pages) == html.weights_from(html.tag_counts(page))


def hidden(page):
    return re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", page)


def labelled(r, noise):
    words = lambda n: " ".join(r.choice(["ab", "cd", "ef", "gh"]) + str(r.randint(0, 99)) for _ in range(n))
    story = [words(r.randint(8, 40)) for _ in range(r.randint(3, 8))]
    before = "".join(f'<div class="{noise} col"><span>{words(r.randint(3, 12))}</span></div>' for _ in range(4))
    body = "".join(f'<p class="para">{x}</p>' for x in story)
    return f"<html><body>{before}<article>{body}</article>{before}</body></html>", "\n".join(story)


def test_the_scan_finds_the_content_with_its_element_hidden():
    """What is outside bears words that no list knows; without the scan, or without learned weights, it would stay."""
    r = random.Random(3)
    pages = [labelled(r, "zone-q") for _ in range(60)]
    counts = sum((html.tag_counts(p) for p, _ in pages[:40]), Counter())
    weights = html.weights_from(counts)
    assert weights["div.zone"] > 0 > weights["p.para"]
    for page, story in pages[40:]:
        assert html.main_text(page, weights) == html.main_text(hidden(page), weights) == story
        assert html.main_text(hidden(page), {}) != story
        everything = "\n".join(v for k, v, aside, _, _ in html.marked(hidden(page)) if k == "text" and not aside)
        assert everything != story


def test_the_region_is_the_best_of_all():
    r = random.Random(4)
    for _ in range(300):
        scores = [float(r.randint(-6, 6)) for _ in range(r.randint(0, 25))]
        a, b = html.best_region(scores)
        assert sum(scores[a:b]) == max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a b="', "<", "</", "<!--", "<script>", "<p>", "<div class=x", "&amp;", "<a x=\"'> "])
def test_long_broken_pages_take_linear_time(unit):
    began = time.time()
    html.main_text("<p>start of it</p>" + unit * (1_000_000 // len(unit)), {})
    assert time.time() - began < 8


def test_tokens_of_broken_markup():
    assert list(html.tokens("a < b <p x='>'>c</p><br/>d<!-- <p> -->e<title>t</title>f<i")) == [("text", "a < b ", ""), ("open", "p", " x='>'"), ("text", "c", ""), ("close", "p", ""), ("open", "br", "/"), ("text", "d", ""), ("text", "e", ""), ("text", "f<i", "")]
    assert [t[0] for t in html.tokens("<p a='x>one<b>two</b>")] == ["open", "text", "open", "text", "close"]
