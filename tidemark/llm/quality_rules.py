"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

All is built-in column expressions over one row at a time: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, let, read

#: What separates words.
BLANK = r"[ \t-\r]"
#: A line ends as a sentence does: closing punctuation, then perhaps quotes or brackets.
ENDS_SENTENCE = r"""[.!?:;,…。！？؟।]["'”’»)\]]*[ \t-\r]*$"""
#: A separator of menu entries that stands alone.
NAVIGATION = r"(^|[ \t-\r])[|»›•·]([ \t-\r]|$)"
#: Phrases of page furniture.
BOILERPLATE = r"(?i)(cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|sign up for our|subscribe to our|powered by)"
#: Capitals without any small letter.
SHOUTING = r"^\P{Ll}*\p{Lu}\P{Ll}*$"
SYMBOLS = "#*$%&|<>"
#: A line fails if more than 1 in so many of its characters are symbols.
SYMBOL_SHARE = 12
#: A line without a sentence's end passes if it has at least so many words, as a hard-wrapped line of prose does.
WRAPPED_WORDS = 8
#: A document is rejected if more than this percentage of the characters of its lines goes.
LOSS_PERCENT = 50
#: Words of a repeated window.
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window found twice or more among these words, the first time included."""

    def covered(starts: Column) -> Column:
        pairs = F.array_sort(F.transform(starts, lambda i: F.struct(F.slice(words, i + 1, window).alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])
            return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))

        def total(p: Column) -> Column:
            # Each window adds its words up to the start of the next one; the last has no next one and adds all.
            added = F.transform(p, lambda a, k: F.least(F.get(p, k + 1) - a, F.lit(window)))
            return F.aggregate(added, F.lit(0), lambda acc, x: acc + x)

        return let(let(pairs, places), total)

    starts = F.sequence(F.lit(0), F.size(words) - window)
    windows = lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    # Equal windows have equal hashes, and most texts have no hash twice; only the others are sorted, by their words.
    of_hashes = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(starts))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), of_hashes))


def line_passes(line: Column) -> Column:
    wrapped = F.size(words_of(line)) >= WRAPPED_WORDS
    return ~line.rlike(BLANK.replace("[", "^[") + "*$") & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE) & ~line.rlike(SHOUTING) & (count_of(line, SYMBOLS) * SYMBOL_SHARE <= F.length(line)) & (line.rlike(ENDS_SENTENCE) | wrapped)


def measured(docs: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """docs with two columns more, and over these: a struct of counts (with clean, the lines that pass), and both verdicts."""
    of_words, of_lines = free(docs.columns, "of_words", "of_lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    clean = F.filter(F.split(text, "\n"), line_passes)
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x))
    out = docs.withColumn(of_words, let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))).withColumn(
        of_lines,
        F.struct(
            let(full, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), size(x).cast("long").alias("n_full"))).alias("full"),
            let(clean, lambda x: F.struct(F.array_join(x, "\n").alias("text"), size(x).cast("long").alias("n_clean"))).alias("clean"),
        ),
    )
    w, lines = F.col(of_words), F.col(of_lines)
    base_failed = (w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])
    kept = ~base_failed & ((lines["full"]["n_full"] - lines["clean"]["n_clean"]) * 100 <= lines["full"]["n_full"] * LOSS_PERCENT)
    counts = F.struct(w["n_words"].alias("n_words"), w["n_repeat_words"].alias("n_repeat_words"), lines["full"]["n_dup_lines"].alias("n_dup_lines"), lines["clean"]["text"].alias("clean"))
    return out, counts, base_failed, kept


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept per row.

    Null and empty texts have no words, fail the base and are not kept. Repeated rows are judged once each; lines that
    differ in white space are different lines. Long texts are judged whole. Empty tables give no rows. Other columns are
    not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out, counts, base_failed, kept = measured(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        counts["n_words"].alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        counts["n_dup_lines"].alias("n_dup_lines"),
        counts["n_repeat_words"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        kept.alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The columns of docs for documents that are kept, with failing lines removed from text and n_chars, if there, made to fit.

    Null and empty texts go. Ties, repeated rows, long texts and empty tables are as in judge; other columns stay as they
    are and may have any names.
    """
    out, counts, _, kept = measured(docs)
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": counts["clean"]}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(counts["clean"]).cast(docs.schema["n_chars"].dataType)
    return out.where(kept).select(*[c.alias(name) for name, c in columns.items()])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
lines AS (SELECT *, list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
grams AS (SELECT rid, s, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS s FROM docs WHERE len(w) >= 5)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 5)) AS p FROM twice) GROUP BY rid),
clean AS (
  SELECT rid, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS n_full,
    coalesce(list_sum(list_transform(list_filter(l, lambda x:
      NOT regexp_matches(x, '(^|[ \t-\r])[|»›•·]([ \t-\r]|$)')
      AND NOT regexp_matches(x, '(?i)(cookie (policy|settings)|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|sign up for our|subscribe to our|powered by)')
      AND NOT regexp_matches(x, '^\P{Ll}*\p{Lu}\P{Ll}*$')
      AND (length(x) - length(translate(x, '#*$%&|<>', ''))) * 12 <= length(x)
      AND (regexp_matches(x, '[.!?:;,…。！？؟।]["''”’»)\]]*[ \t-\r]*$') OR len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 8)), lambda x: length(x))), 0) AS n_clean
  FROM lines),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, n_full, n_clean
  FROM lines JOIN clean USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_full - n_clean) * 100 <= n_full * 50 AS kept
FROM counted
"""
