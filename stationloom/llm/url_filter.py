"""URL filters: host-suffix and path-prefix expressions joined on hash prefixes.

A rule is ``(host, path, verdict)``.  It fits a URL whose host is the rule's
host or a subdomain of it and whose path starts with the rule's path.  Each
URL is expanded into the expressions (host suffix + path prefix) of the shapes
that occur among the rules, the expressions are equi-joined with the rules on
the first 32 bits of their SHA-256, and a join partner counts only if the full
digests agree.  Among the rules that fit, the longest ``host + path`` wins,
then the longer host, then ``block`` before ``allow``.

Defined results: a null URL, or one without ``://``, has empty host and path;
an empty path fits only a rule with an empty path; a URL that no rule fits
gets ``default`` (``allow``) and a null rule; repeated rows are judged each;
an empty table gives an empty result; other columns of the input, whatever
their names, are not read.  Rules that repeat are counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (about 30 MB); more are joined by shuffle.
BROADCAST_RULES = 200_000
HASH_PREFIX = 8  # hex digits of the digest that the join uses

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules from a list of (host, path, verdict) or a DataFrame with these columns."""
    if isinstance(rules, DataFrame):
        table = rules.select("host", "path", "verdict")
    else:
        table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    table = table.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    digest = F.sha2(F.concat("host", "path").cast("binary"), 256)
    return table.select(
        "host",
        "path",
        "verdict",
        digest.alias("rule_digest"),
        F.substring(digest, 1, HASH_PREFIX).alias("short"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("found"),
    )


def filter_urls(pages: DataFrame, rules, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of ``pages``.

    The shapes (label count of the host, length of the path) among the rules
    are collected: at most 127 label counts times the longest rule path.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    few = not isinstance(rules, DataFrame) and len(rules) <= BROADCAST_RULES
    few = few or len(table.select("short").limit(BROADCAST_RULES + 1).toArrow()) <= BROADCAST_RULES
    shapes = [tuple(r) for r in table.select(_labels(F.col("host")), F.length("path")).distinct().collect()]

    parts = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    ).na.fill("", ["host", "path"])
    expressions = F.array(
        *[
            F.when(
                (_labels(F.col("host")) >= n) & (F.length("path") >= size),
                F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, size)),
            )
            for n, size in shapes
        ]
    ) if shapes else F.array().cast("array<string>")
    digests = F.transform(F.array_compact(expressions), lambda e: F.sha2(e.cast("binary"), 256))
    asked = parts.select("*", F.explode_outer(digests).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, HASH_PREFIX))
    side = table.select("short", "rule_digest", "found")
    joined = asked.join(F.broadcast(side) if few else side, "short", "left")
    confirmed = F.when(F.col("rule_digest") == F.col("digest"), F.col("found"))
    best = joined.groupBy("row").agg(
        F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("found")
    )
    return best.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES)


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {
    "op1_url_filter": """
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ranked AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY row_no ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC, r.verdict DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
""",
}
