"""URL filters: pattern rules found by their rarest literal token.

A rule is a text in the usual filter-list notation:

    ||host/path   begins at a host or one of its parent domains
    |x and x|     the URL begins or ends here
    *             any characters
    ^             one separator (no letter, digit or ``_.%-``) or the end

``compiled`` turns rules into regular expressions and into their literal
tokens: runs of a-z and 0-9 that every fitting URL must hold as whole tokens.
``indexed`` counts those tokens over the URLs and files each rule under its
rarest one. ``matches`` splits each URL into tokens, fetches by an equality join
the rules filed under them, and runs only those expressions. A rule without any
such token is filed under the empty token, which every URL has, so none is lost.

``judge`` decides: site rules (``||host/path`` without wildcards) go first and the longest
wins (equally long: block first, then by text); else an exception (action
``allow``) goes before a block; a URL that no rule fits is allowed. All
of it is column expressions, joins and aggregates; no Python worker runs.

Hosts are compared with A-Z lower-cased, all else as written. The rules are
broadcast behind a check of their size, else joined by shuffle.

Edge cases: a null url has an empty host and path, fits no rule and is allowed;
without ``://`` host and path are empty, only rules without ``||`` can fit;
null page ids and repeated rows each get a row; very long URLs are read whole; an
empty table gives none, and so do no rules no match. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.plans.joins import bounded_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"

# the production list: (rule, action)
SITE_RULES = [("||org/", "allow"), ("||example.org/es/", "block"), ("||example.org/en/1", "block"), ("||com/fr/", "allow"), ("||com/de/", "block")]
PATTERN_RULES = [("||ads-track.", "block"), ("||spam-farm.", "block"), ("||cheap-pills.", "block"), ("||spam-farm.example.net/fr/*", "allow"),
                 ("/login^", "block"), ("/tag/*/feed^", "block"), ("^replytocom=", "block"), ("^sessionid=*&page=", "block"),
                 ("|http://m.*.html|", "block"), ("||example.net^*.html^page=2&", "block"), ("/de/*utm_source=feed|", "allow")]
RULES = SITE_RULES + PATTERN_RULES


def folded(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, ``site`` (the URL from its host on) and ``full``, both with the host folded."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = folded(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    site = F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest)))
    return pages.withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit("")),
        "site": site, "full": F.when(at > 0, F.concat(F.substring(F.col(url), F.lit(1), at + 2), site)).otherwise(F.col(url))})


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """A list of rules as a table, by a JSON literal (a list handed to Spark would start Python workers)."""
    text = json.dumps([{"rule": r, "action": a} for r, a in rules])
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(text), "array<struct<rule:string,action:string>>")).alias("r")).select("r.*")


def compiled(rules: DataFrame) -> DataFrame:
    """rules (rule, action) with ``regex``, ``by_site`` (which text it runs on),
    ``site_rule``, and ``tokens``."""
    text = F.col("rule")
    by_site = text.startswith("||")
    ends = text.endswith("|") & ~text.isin("|", "||")
    body = F.regexp_replace(text, r"\A\|\|?|\|\z", "")
    body = F.regexp_replace(body, r"\*{2,}", "*")
    body = F.when(text.startswith("|"), body).otherwise(F.regexp_replace(body, r"\A\*", ""))     # a wildcard at an open end says nothing
    body = F.when(ends, body).otherwise(F.regexp_replace(body, r"\*\z", ""))
    body = F.regexp_replace(body, r"([\\.+?$(){}\[\]|])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    start = F.when(by_site, r"\A(?:[^/?#]*\.)?").when(text.startswith("|"), r"\A").otherwise("")
    regex = F.concat(F.lit("(?s)"), start, body, F.when(ends, r"\z").otherwise(""))
    # what bounds a token: any other literal, an anchor or a separator, but no wildcard or open end
    open_ended = F.concat(F.when(text.startswith("|"), "").otherwise("*"), folded(text), F.when(ends, "").otherwise("*"))
    tokens = F.regexp_extract_all(open_ended, F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0))
    return rules.select("rule", "action", regex.alias("regex"), by_site.alias("by_site"),
                        text.rlike(r"\A\|\|[^/*^|]+/[^*^|]*\z").alias("site_rule"),
                        F.array_distinct(tokens).alias("tokens"))


def url_tokens(url: Column) -> Column:
    """The distinct literal tokens of a URL, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(folded(url), F.lit("[a-z0-9]+"), F.lit(0))))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules with ``token``, the rarest of their tokens among ``urls`` (url)."""
    kept = [c for c in rules.columns if c != "tokens"]
    listed = rules.withColumn("token", F.explode_outer("tokens"))
    wanted = bounded_broadcast(listed.where(F.col("token").isNotNull()).select("token").distinct())
    counts = (urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(wanted, "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")
    return (listed.join(counts, "token", "left").groupBy(*kept)
            .agg(F.coalesce(F.min_by("token", ranked), F.lit("")).alias("token")))


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, rule, action, site_rule) of the rules that fit: candidates come by token."""
    # the parts are cut for URLs with a candidate only
    rows = urls.where(F.col("url").isNotNull()).select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    found = with_parts(rows.join(bounded_broadcast(index), "token"))
    subject = F.when(F.col("by_site"), F.col("site")).otherwise(F.col("full"))
    return found.where(F.regexp_like(subject, F.col("regex"))).select("url", "rule", "action", "site_rule")


def verdicts(hits: DataFrame) -> DataFrame:
    """One row for each URL with a hit: the deciding rule."""
    block = (F.col("action") == "block").cast("int")
    # the greatest wins: site rules by length, then blocks; other rules exceptions first; then the smaller text
    rank = F.struct(F.col("site_rule").cast("int"), F.when(F.col("site_rule"), F.length("rule")).otherwise(0),
                    F.when(F.col("site_rule"), block).otherwise(1 - block))
    best = hits.withColumn("rank", rank).groupBy("url", "rank").agg(F.min(F.struct("rule", "action", "site_rule")).alias("best"))
    return best.groupBy("url").agg(F.max_by("best", "rank").alias("best")).select("url", "best.*")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (the site rule that decides, like ``net/``), pattern
    (the other rule that decides) and verdict of every page."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = pages.select("url")
    decided = verdicts(matches(urls, indexed(compiled(rules), urls)))
    site = F.coalesce("site_rule", F.lit(False))
    return with_parts(pages.join(decided, "url", "left")).select(
        "page_id", "host", "path", F.when(site, F.substring(F.col("rule"), F.lit(3), F.length("rule"))).alias("rule"),
        F.when(~site, F.col("rule")).alias("pattern"), F.coalesce("action", F.lit("allow")).alias("verdict"))
