"""URL filters: rules indexed by their rarest literal token.

A rule names a host (with all its subdomains) and the beginning of a path.  Its
literal tokens are the host's labels and the path's complete segments.  How often
each of them occurs is counted over all urls, and the rule is filed under the
rarest.  A url's tokens fetch the rules filed under them, by a join; only those run
their regular expressions, and the longest that matches decides.

Tables of urls and rules may be of any size: what is broadcast is counted first.

Defined cases.  Null urls and urls without ``://``: empty host and path, which only a
rule without a host can fit.  Of matching rules of one length the first in text order
decides, then allow before block.  Very long urls are judged whole.  Null page_ids are
kept; repeated rows give equal values; an empty table an empty result, and no rules leave
every url to the default.  Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules or tokens that are broadcast at most.
HELD = 100_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    text: str  # host and path, as in example.org/es/


def host(url):
    """A column: after the first :// up to /, ?, # or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url):
    """A column: after the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(name: Column) -> Column:
    return F.transform(F.split(name, r"\."), lambda x: F.concat(F.lit("h:"), x))


def _segments(where: Column) -> Column:
    return F.transform(F.filter(F.split(where, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def rule_table(rules: DataFrame) -> DataFrame:
    """verdict, text, tokens and the two expressions of each distinct rule (verdict, text)."""
    name, rest = F.substring_index("text", "/", 1), F.expr("substring(text, length(substring_index(text, '/', 1)) + 2)")
    rules = rules.select("verdict", "text").filter("text IS NOT NULL").distinct().withColumns({"name": name, "rest": rest})
    # The last segment is only a beginning: no token.
    whole = F.concat_ws("/", F.slice(F.split("rest", "/"), 1, F.size(F.split("rest", "/")) - 1))
    tokens = F.array_distinct(F.concat(_labels(F.col("name")), _segments(whole)))
    on_host = F.concat(F.lit(r"(?s)\A(?:.*\.)?"), _quoted(F.col("name")), F.lit(r"\z"))
    return rules.select("verdict", "text", tokens.alias("tokens"), on_host.alias("on_host"), F.concat(F.lit(r"\A"), _quoted(F.concat(F.lit("/"), "rest"))).alias("on_path"))


def _held(table: DataFrame) -> DataFrame:
    """To be broadcast if it is small; otherwise Spark chooses the join."""
    return F.broadcast(table) if table.limit(HELD + 1).count() <= HELD else table


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, otherwise: str = "allow", key: str = "page_id") -> DataFrame:
    """Per row of ``pages`` (key, url): key, host, path, rule, verdict, rules_tried.

    ``rules`` may be a list or a table (verdict, text) of any size.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, text string")
    pages = pages.select(key, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # A host and path are judged once, however many rows hold them.
    sites = pages.groupBy("host", "path").agg(F.count("*").alias("rows"))
    tokens = F.explode(F.array_distinct(F.concat(_labels(F.col("host")), _segments(F.col("path"))))).alias("token")
    table = rule_table(rules)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = sites.select("rows", tokens).join(_held(wanted), "token").groupBy("token").agg(F.sum("rows").alias("seen"))
    each = table.select("verdict", "text", "on_host", "on_path", F.explode("tokens").alias("token")).join(seen, "token", "left")
    filed = each.groupBy("verdict", "text", "on_host", "on_path").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("rarest"))
    fetched = sites.select("host", "path", tokens).join(_held(filed.select("verdict", "text", "on_host", "on_path", F.col("rarest.token").alias("token"))), "token")
    fits = F.rlike("host", F.col("on_host")) & F.rlike("path", F.col("on_path"))
    best = F.min(F.when(fits, F.struct((-F.length("text")).alias("size"), "text", "verdict"))).alias("best")
    judged = fetched.groupBy("host", "path").agg(best, F.count("*").cast("int").alias("tried"))
    rule, verdict = F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    return pages.join(judged, ["host", "path"], "left").select(key, "host", "path", rule, verdict, F.coalesce("tried", F.lit(0)).alias("rules_tried"))
