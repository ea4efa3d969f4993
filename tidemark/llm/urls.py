"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each url becomes one expression for every (host suffix, path prefix) that a rule could have: suffixes of at most as many
labels as the longest rule host, prefixes of the lengths that rule paths have. Expressions meet rules in an equi-join on
the first four bytes of SHA-256; a match counts only if the full digests agree; the longest rule then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, read

#: The rules of op1 (fixed values): host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hexadecimal digits of a digest that the join uses.
PREFIX = 8
#: A rule list of at most this many entries is broadcast; a longer one is joined by shuffle.
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> tuple[DataFrame, bool]:
    """Rules as a table (host, path, verdict), and whether it is known to be small."""
    if isinstance(rules, DataFrame):
        few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
        return rules.select("host", "path", "verdict"), few
    if len(rules) > 1000:
        return spark.createDataFrame(rules, "host string, path string, verdict string"), len(rules) <= BROADCAST_RULES
    values = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    table = spark.range(1).select(F.inline(F.array(*values))) if values else spark.createDataFrame([], "host string, path string, verdict string")
    return table, True


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path as one string, null if none fits) and verdict per row of pages.

    Of rules of equal length the one with the longer host wins, then `block`. Repeated rows and page_ids, null ids
    included, are judged once each. Null, empty and malformed urls have an empty host and path, which no rule fits.
    With no rules all take the default; an empty table gives no rows. Other columns are not read.
    """
    table, few = rule_table(pages.sparkSession, rules)
    shape = table.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 1, sorted(shape["lengths"])  # as many as rule paths have different lengths
    keyed = table.select(
        F.sha2(F.concat("host", "path"), 256).alias("_digest"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"), F.concat("host", F.substring("path", 1, 1 << 30)).alias("rule"), "verdict").alias("_rule"),
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX))
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("_row", F.monotonically_increasing_id())
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.sha2(F.concat(s, F.substring(F.col("path"), F.lit(1), n)), 256))))
    exploded = parsed.withColumn("_expression", F.explode_outer(expressions)).withColumn("_prefix", F.substring("_expression", 1, PREFIX))
    right = F.broadcast(keyed) if few else keyed
    joined = exploded.join(right, "_prefix", "left")
    confirmed = F.when(F.col("_digest") == F.col("_expression"), F.col("_rule"))
    # All expressions of a url are in one task, so the partial aggregate leaves one row per url to be shuffled.
    best = joined.groupBy("_row", "page_id", "host", "path").agg(F.max(confirmed).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


OP1_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fits AS (
  SELECT p.rid, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (rid)
"""
