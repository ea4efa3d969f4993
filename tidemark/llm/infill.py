"""Fill-in-the-middle: a text is cut at two unit borders and its middle is moved to the end.

Units are cut by lookaround: each unit grammar has a zero-width pattern that matches where one unit ends and the next
begins, told by the classes of the characters before and after. Spark's split at such a pattern loses no character, so
the pieces joined give the text again. Everything is a projection over whole texts with built-in functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, let, read


class Unit(NamedTuple):
    """grammar: what one unit is, matched left to right; border: where a unit ends and another begins."""

    grammar: str
    border: str


_BLANK = r"\x20\x09-\x0D"
UNITS = {
    # A word with the blanks before it; blanks that no word follows are a unit of their own.
    "token": Unit(rf"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+", rf"(?<=[^{_BLANK}])(?=[{_BLANK}])"),
    # A stretch of blanks or of anything else.
    "run": Unit(rf"[^{_BLANK}]+|[{_BLANK}]+", rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[{_BLANK}])(?=[^{_BLANK}])"),
    "line": Unit(r"[^\n]*\n|[^\n]+", r"(?<=\n)(?=[\s\S])"),
    "character": Unit(r"[\s\S]", r"(?<=[\s\S])(?=[\s\S])"),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: texts that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42


def units(text: Column, unit: str = "token") -> Column:
    """The pieces of a text, which joined give it again; none for an empty text (which split alone would call one piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS[unit].border, -1))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Markers are found from the left; no text that is transformed holds any."""
    after = lambda mark: F.substring_index(output, mark, -1)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(F.substring_index(body, SUFFIX, 1), after(MIDDLE), F.substring_index(after(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(PREFIX), MIDDLE, 1), after(MIDDLE), F.substring_index(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "token", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output per row of docs.

    Null texts count as empty; an empty text has no units and stays plain, as does one that holds a marker. Cuts are drawn
    from the hash of the doc_id, so repeated rows come out alike, once each; a null id draws as an empty one. Both cuts may
    fall on the same border or on an end of the text: then a part is empty. Long texts are cut whole, in time that grows
    with their length. Empty tables give no rows. Other columns are not read.
    """
    text, n, a, b, form, prefix, middle, suffix, digest = free(["doc_id"], "text", "n", "a", "b", "form", "prefix", "middle", "suffix", "digest")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(F.col(digest), 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.contains(F.col(text), F.lit(PREFIX)) | F.contains(F.col(text), F.lit(SUFFIX)) | F.contains(F.col(text), F.lit(MIDDLE))
    kind = (
        F.when((F.col(text) == "") | marked | (F.pmod(number(2), F.lit(100)) >= rate), "plain")
        .when(F.pmod(number(3), F.lit(100)) < suffix_first, "spm")
        .otherwise("psm")
    )

    def cut(pieces: Column) -> Column:
        size = F.size(pieces)
        one, other = F.pmod(number(0), size + 1).cast("int"), F.pmod(number(1), size + 1).cast("int")
        low, high = F.least(one, other), F.greatest(one, other)
        part = lambda since, many: F.when(F.col(form) != "plain", F.array_join(F.slice(pieces, since, many), ""))
        return F.struct(size.cast("long").alias(n), part(F.lit(1), low).alias(prefix), part(low + 1, high - low).alias(middle), part(high + 1, size - high).alias(suffix))

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text)).withColumn(digest, drawn)
    rows = rows.withColumn(form, kind).withColumn(a, let(units(F.col(text), unit), cut)).select("doc_id", text, form, f"{a}.*")
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    parts = [F.col(c) for c in (prefix, middle, suffix)]
    output = F.when(F.col(form) == "psm", F.concat(p, parts[0], s, parts[2], m, parts[1])).when(F.col(form) == "spm", F.concat(s, parts[2], p, parts[0], m, parts[1])).otherwise(F.col(text))
    return rows.select("doc_id", F.col(n).alias("n"), F.col(form).alias("form"), *parts, output.alias("output"))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(units[1:a], '') END AS pre, CASE WHEN form <> 'plain' THEN array_to_string(units[a + 1:b], '') END AS mid,
    CASE WHEN form <> 'plain' THEN array_to_string(units[b + 1:n], '') END AS suf
  FROM c)
SELECT doc_id, n, form, CAST(length(pre) AS BIGINT) AS prefix_chars, CAST(length(mid) AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
