"""URL filter: rules indexed by their rarest literal token; only rules a URL's tokens fetch run their pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; both empty without ``://``."""
    c = F.col(f"`{url}`").cast("string")
    rest = F.when(F.instr(c, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Host labels and whole path segments, told apart by their prefix; the empty token every URL has."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def rule_rows(rules: list[Rule]) -> list[tuple]:
    """rule, verdict, length, pattern over host and path, literal tokens."""
    out = []
    for host, path, verdict in dict.fromkeys(rules):
        pattern = (r"^(?:[^/]*\.)?" + re.escape(host) if host else r"^[^/]*") + re.escape(path)
        literal = [f".{x}" for x in host.split(".") if x] + [f"/{x}" for x in path.split("/")[1:-1] if x]
        out.append((host + path, verdict, len(host + path), len(host), pattern, literal or [""]))
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of the longest rule that fits each URL, or ``default``.

    A rule (host, path, verdict) fits its host and all subdomains when the URL's path starts with the rule's.
    Of fitting rules of equal length the one with the longer host wins, then ``block``. Returns ``key``,
    ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``, one row per input row, repeated rows and
    null keys included. A null URL, an empty one or one without ``://`` has an empty host and path. Other
    columns are ignored; an empty table or an empty rule list gives every row the default.
    """
    spark = pages.sparkSession
    host, path = parts(url)
    schema = "rule string, verdict string, length int, host_length int, pattern string, literal array<string>"
    table = spark.createDataFrame(rule_rows(rules), schema)
    urls = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"))

    # Rarest literal token of each rule, by the URLs that hold it.
    literal = table.select("rule", "verdict", F.explode("literal").alias("token"))
    held = urls.select(F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = held.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = literal.join(counts, "token", "left").groupBy("rule", "verdict").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token")
    )
    index = table.join(rarest, ["rule", "verdict"]).select(
        F.col("token").alias("rule_token"), "rule", "verdict", "length", "host_length", "pattern"
    )

    # The candidates of a URL are next to each other, so each task sends one row per URL.
    each = urls.withColumn("row", F.monotonically_increasing_id())
    each = each.withColumn("token", F.explode(tokens(F.col("host"), F.col("path"))))
    fits = (F.col("token") == F.col("rule_token")) & F.expr("concat(host, path) rlike pattern")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("length", "host_length", F.col("verdict") == "block", "rule", "verdict")))
    found = each.join(index, fits, "left").groupBy("row").agg(
        F.first("key").alias(key), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best")
    )
    return found.select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
