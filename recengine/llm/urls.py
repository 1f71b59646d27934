"""URL filters by hash prefixes, in DataFrame functions only.

Every distinct URL is expanded into the host suffixes and path prefixes that any rule could have (the label counts and path
lengths that occur among the rules), each expression is hashed, and the first 32 bits of the digest are joined with those
of the rules. What joins is confirmed by the full digest, and of a URL's rules the longest holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hexadecimal digits of a digest that are joined on


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(whole, r"^([^/]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(whole, F.length(host) + 1, F.length(whole))
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that holds, or null) and verdict (its, or ``default``).

    ``rules`` has host, path, verdict ("allow" or "block"). A rule fits its host and subdomains of it where the path starts with
    the rule's; the longest host and path together wins, then the longer host, then "block". Null URLs and those without ://
    have an empty host and path, which fit only a rule of both empty. Repeated pages are each judged. A rule with a null
    is passed over; no rules leave all to ``default``. Columns of ``pages`` named as a result give way.
    """
    kept = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(kept[f"`{url}`"].cast("string"))
    at = kept.select("*", host.alias("host"), path.alias("path"))
    labels = lambda c: F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1)
    own = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat("host", "path").alias("_rule"), F.length("host").alias("_host"), "verdict", labels(F.col("host")).alias("_labels"), F.length("path").alias("_length")
    )
    #: As many as hosts have labels and paths have characters: a few hundred at most, whatever the number of rules.
    shapes = own.agg(F.sort_array(F.collect_set("_labels")).alias("l"), F.sort_array(F.collect_set("_length")).alias("p")).first()
    digest = F.sha2(F.col("_rule"), 256)
    listed = own.groupBy("_rule", "_host").agg(F.max("verdict").alias("_says")).select("_rule", "_host", "_says", digest.alias("_full"), F.substring(digest, 1, PREFIX).alias("_short"))
    has = labels(F.col("host"))
    suffixes = F.filter(F.array(*(F.when(has >= k, F.substring_index("host", ".", -k) if k else F.lit("")) for k in shapes["l"])) if shapes["l"] else F.array(F.lit(None).cast("string")), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in shapes["p"])) if shapes["p"] else F.array(F.lit(None).cast("string")), lambda x: x.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    told = (
        at.select("host", "path").distinct().select("host", "path", F.explode(both).alias("_expression"))
        .withColumn("_digest", F.sha2("_expression", 256)).withColumn("_short", F.substring("_digest", 1, PREFIX))
        .join(listed, "_short").where("_digest = _full AND _expression = _rule")
        .groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("n"), F.col("_host").alias("h"), F.col("_says").alias("v"), F.col("_rule").alias("r"))).alias("_best"))
    )
    judged = at.join(told, ["host", "path"], "left")
    return judged.select(*(judged[f"`{c}`"] for c in kept.columns), "host", "path", F.col("_best.r").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))
