"""URL filtering: host-suffix and path-prefix expressions joined to rules on short digest prefixes.

A URL expands into the suffixes of its host times the prefixes of its path, at the numbers of labels and lengths that
rules have. Expressions
meet rules in an equi-join on the first four bytes of their SHA-256; the full digest confirms, the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules of the query: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """Array of (host suffix, path prefix): suffixes have one of ``labels`` numbers of labels, prefixes one of ``lengths`` characters."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    fit = F.filter(lengths, lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(fit, lambda n: F.struct(h.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row: page_id, host, path, rule, verdict.

    ``rules(verdict, host, path)``: a rule fits its host and all subdomains if the path starts with the rule's. Of the
    rules that fit, the longest (host and path together, then the longer host) wins; of rules with equal host and path,
    ``allow`` wins. Without one, rule is null and the verdict ``default``. Null URLs and those without ``://`` have an
    empty host and path. Work is done once per distinct host and path; repeated rows are all returned. An empty
    table gives no rows, an empty rule table only defaults. Other columns are ignored.
    """
    seen = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    unique = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = unique.select(
        F.struct(
            (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict"
        ).alias("found"),
        F.substring(digest(F.col("host"), F.col("path")), 1, 8).alias("short"),
        digest(F.col("host"), F.col("path")).alias("full"),
    )
    # one row: how many labels rule hosts have and how long rule paths are, a few dozen numbers whatever the number of rules
    lengths = unique.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"))
    urls = seen.select("host", "path").distinct()
    asked = urls.join(F.broadcast(lengths)).select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), F.col("labels"), F.col("lengths"))).alias("e"))
    asked = asked.select("host", "path", digest(F.col("e.host"), F.col("e.path")).alias("asked")).withColumn("short", F.substring("asked", 1, 8))
    hits = asked.join(keyed, "short").where("asked = full").groupBy("host", "path").agg(F.max("found").alias("found"))
    return seen.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m AS (
  SELECT p.page_id, p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS v
  FROM p LEFT JOIN r ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
