"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score +1, tags by weights of their names and of the class and id words they
bear; a linear scan finds the contiguous region with the largest sum. Weights come from labelled pages, those that mark
their content with an article or main element: what stands outside the content costs the more the more often it does,
what stands inside it scores. The scan takes the tags of these elements for costly ones and knows no more of them, so
pages without them are cut alike.
Elements that are no content wherever they stand (menus, adverts, forms, comments ...) score nothing and are left out of
the region found, so that one inside an article does not end it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read, sliced

#: Labelled pages that the weights are taken from at most: those with the smallest hashes of their ids.
MAX_PAGES = 2_000
#: Words that a tag weighs at a log-odds of 1; what a tag can cost or gain at most.
SCALE, MOST, GAIN = 5.0, 40.0, 1.0

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: Elements whose content is no markup, and what ends each.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template noscript svg iframe textarea select title".split()}
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no content; a header only outside the content element, where an article's own title may stand.
ASIDE = frozenset("nav footer aside form button dialog menu head".split())
CONTENT = frozenset(["article", "main"])
#: Words of class, id and role values that mark elements without content.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup footer pagination contentinfo complementary search widget masthead topbar toolbar login skip".split())
#: Class and id values of page headers, which count outside the content only.
HEADERS = frozenset("header site-header page-header main-header top-header global-header header-top header-main".split())
#: Names that speak of what an element has beside it, such as with-sidebar.
ABOUT = frozenset(["with", "has", "no", "without"])
WORDS = re.compile(r"[a-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("open", name, attributes) and ("close", name, "") in page order; scripts, styles and comments are passed over.

    Linear in the page: a quote that is never closed is looked for once, after that tags end at the next angle bracket.
    """
    since = at = 0
    quoted = True
    while (k := page.find("<", at)) >= 0:
        m = NAME.match(page, k)
        attributes = ""
        if m:
            inner = ATTRIBUTES.match(page, m.end()) if quoted else None
            if inner:
                end = inner.end()
            else:
                quoted = False
                end = page.find(">", m.end()) + 1
                if not end:
                    break
            attributes = page[m.end() : end - 1]
        elif page.startswith("<!--", k):
            end = page.find("-->", k + 4) + 3
            end = len(page) if end < 3 else end
        elif page[k + 1 : k + 2] in ("!", "?", "/"):
            end = page.find(">", k) + 1 or len(page)
        else:
            at = k + 1
            continue
        if k > since:
            yield "text", page[since:k], ""
        if m:
            name = m[2].lower()
            if name in RAW and not m[1]:
                closing = RAW[name].search(page, end)
                end = closing.end() if closing else len(page)
            elif name not in RAW:
                yield ("close" if m[1] else "open"), name, attributes
        since = at = end
    if since < len(page):
        yield "text", page[since:], ""


def words_in(attributes: str) -> list[str]:
    """The words of class, id and role values."""
    if "=" not in attributes:
        return []
    return [w for m in NAMED.finditer(attributes) for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower())]


def is_aside(name: str, attributes: str, inside: int) -> bool:
    if name in ASIDE or (name == "header" and not inside):
        return True
    if "=" not in attributes or name in ("body", "html", "main"):
        return False
    for m in NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            if token.replace("_", "-") in HEADERS and not inside:
                return True
            words = WORDS.findall(token)
            if words and words[0] not in ABOUT and (words[0] in MARKS or words[-1] in MARKS):
                return True
    return False


def marked(page: str) -> list[tuple[str, str, bool, int, tuple[str, ...]]]:
    """(kind, value, is aside, depth of content elements, what a tag is weighed by) per token.

    Tags are weighed by their name and by name and word for each word of their class and id; end tags as their start tags.
    """
    out, skip, depth, inside, seen = [], "", 0, 0, False
    starts: dict[str, list[tuple[str, ...]]] = {}
    for kind, value, attributes in tokens(page):
        features: tuple[str, ...] = ()
        if kind == "open":
            features = (value, *(f"{value}.{w}" for w in words_in(attributes))) if value not in CONTENT else (value,)
            if value not in VOID:
                starts.setdefault(value, []).append(features)
        elif kind == "close":
            held = starts.get(value)
            features = held.pop() if held else (value,)
        if kind == "open":
            if value in CONTENT:
                inside += 1
                if skip in ASIDE or skip == "header" or not seen:
                    skip = ""  # an element left open, or one around the whole layout, ends here at the latest
                seen = True
            if skip == "p" and value in BLOCKS:
                skip = ""  # paragraphs do not nest: a block ends one
            if skip:
                depth += value == skip
            elif value not in VOID and is_aside(value, attributes, inside):
                skip, depth = value, 1
        out.append((kind, value, bool(skip), inside, features))
        if kind == "close":
            if value in CONTENT and inside:
                inside -= 1
                if value != skip and not inside:
                    skip = ""  # what was left open inside the content ends with it
            if skip and value == skip:
                depth -= 1
                if not depth:
                    skip = ""
    return out


def tag_counts(page: str) -> Counter:
    """(feature, is inside the content) of all tags of a labelled page, without those of asides inside the content."""
    out: Counter = Counter()
    for kind, _, aside, inside, features in marked(page):
        if kind != "text" and not (aside and inside):
            for f in set(features) - CONTENT:
                out[f, bool(inside)] += 1
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Costs of features, negative for those that rather stand inside the content."""
    names = {name for name, _ in counts}
    return {n: min(MOST, max(-GAIN, SCALE * log((counts.get((n, False), 0) + 1) / (counts.get((n, True), 0) + 1)))) for n in names}


#: Used for names that no labelled page has: elements of running text, other blocks, and the rest.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong br".split())
LEAST, OTHER, INLINE = 0.02, 0.4, 0.1


def default_weight(name: str) -> float:
    return LEAST if name in PROSE else OTHER if name in BLOCKS else INLINE


def cost(features: tuple[str, ...], weights: dict[str, float]) -> float:
    """What a tag takes from the score: the farthest from none that its words are known for, else that of its name."""
    if features[0] in CONTENT:
        return MOST
    known = [weights[f] for f in features[1:] if f in weights]
    return max(known, key=abs) if known else weights[features[0]] if features[0] in weights else default_weight(features[0])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the largest sum above 0, the first of equal ones and the shortest; (0, 0) if there is none."""
    best = total = 0.0
    begin = first = last = 0
    for k, x in enumerate(scores):
        total += x
        if total > best:
            best, first, last = total, begin, k + 1
        if total <= 0:
            total, begin = 0.0, k + 1
    return first, last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    stream = marked(page or "")
    # Asides score nothing, but for the ends of an outermost content element that a broken one runs over.
    scores = [0.0 if aside and not (value in CONTENT and inside == 1) else float(len(value.split())) if kind == "text" else -cost(features, weights) for kind, value, aside, inside, features in stream]
    first, last = best_region(scores)
    blocks, held = [], []
    for kind, value, aside, _, _ in stream[first:last]:
        if kind == "text":
            if not aside:
                held.append(value)
        elif value == "br":
            held.append(" ")
        elif value in BLOCKS:
            blocks.append(held)
            held = []
    blocks.append(held)
    return "\n".join(filter(None, (" ".join(html.unescape("".join(b)).split()) for b in blocks)))


def learn_weights(pages: DataFrame, max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Tag weights from at most max_pages pages that mark their content; empty if there are none."""
    labelled = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    some = labelled.select(F.xxhash64("page_id", "html").alias("_h")).orderBy("_h").limit(max_pages)

    def run(batches):
        total: Counter = Counter()
        for batch in sliced(batches, "html"):
            for page in batch.column("html").to_pylist():
                total.update(tag_counts(page))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["name", "inside", "n"])

    chosen = labelled.withColumn("_h", F.xxhash64("page_id", "html")).join(F.broadcast(some.distinct()), "_h", "left_semi").select("html")
    counts = chosen.mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()  # names of at most max_pages pages
    return weights_from({(r["name"], r["inside"]): r["n"] for r in counts})


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text (blocks joined by line ends, empty if none) and n_chars (code points) per row.

    Null and empty html has no text. Repeated rows and page_ids, null ids included, come out once each. Regions of equal
    score: the first. Long and broken pages are read whole, in time that grows with their length. Empty tables give no
    rows. Other columns are not read.
    """
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
