"""Allow and block rules for URLs, by host suffix and path prefix.

Every URL is expanded into the host suffixes and path prefixes that rules can have. Expressions and rules are joined on
the first bytes of their digests; full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hexadecimal digits of a digest


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to / ? # in lower case (A-Z only), and then up to ? or #; empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(" ", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """All columns of pages, then host, path, rule and verdict.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains if the URL's path starts
    with the rule's. Of several that fit, the longest in host and path together decides, then the longer host, then
    block. Without one, rule is null and verdict is `default`. Null URLs and those without `://` have empty host and path.
    Rules with a null or empty host or another verdict are passed over; a null path of a rule is empty. Repeated
    rows are judged each. Earlier columns named host, path, rule or verdict are replaced.

    Nothing is collected: rules are joined by the number of their host's labels, which tells the path lengths to try,
    then by digest.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where("host <> '' and verdict in ('allow', 'block')")
    rules = rules.withColumns({"labels": F.size(F.split("host", r"\.")), "chars": F.length("path")})
    lengths = rules.groupBy("labels").agg(F.collect_set("chars").alias("lengths"))
    digest = _digest(F.col("host"), F.col("path"))
    rules = rules.select(digest.alias("full"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    rules = rules.groupBy("full").agg(F.max("r").alias("r")).withColumn("short", F.substring("full", 1, PREFIX))
    urls = pages.select("host", "path").distinct()
    # A URL's own host suffixes, and of its path the prefixes as long as those of rules with so many labels.
    suffixes = urls.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("labels"))
    prefixes = F.filter("lengths", lambda n: n <= F.length("path"))
    expanded = suffixes.join(lengths, "labels").select("host", "path", "labels", F.explode(prefixes).alias("chars"))
    expanded = expanded.select("host", "path", _digest(F.expr("substring_index(host, '.', -labels)"), F.left("path", F.col("chars"))).alias("digest"))
    expanded = expanded.withColumn("short", F.substring("digest", 1, PREFIX))
    judged = expanded.join(rules, "short").where("digest = full").groupBy("host", "path").agg(F.max("r").alias("r"))
    names = ["_lakewright_host", "_lakewright_path", "_lakewright_rule"]
    judged = judged.toDF(*names)
    out = pages.join(judged, (F.col("host") == F.col(names[0])) & (F.col("path") == F.col(names[1])), "left")
    found = F.col(names[2])
    return out.withColumns({"rule": found["rule"], "verdict": F.coalesce(found["verdict"], F.lit(default))}).drop(*names)
