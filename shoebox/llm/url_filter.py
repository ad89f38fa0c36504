"""URL filtering by host-suffix and path-prefix rules, with DataFrame functions only.

A url is expanded into the host-suffix + path-prefix expressions that any rule could equal. The expressions meet the distinct
hash prefixes of the rules, 8 bytes a rule, in an equi-join; what is left meets the rules by full digest, host and path are
compared, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, lower_ascii, materialize

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the digest that are compared first, as a number.
HASH_PREFIX = 8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """DataFrame (verdict, host, path) of a written rule list; its size is known to the planner."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    none = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(``id_col``, host, path, rule, verdict), one row for each row of ``pages``.

    A rule fits its host and all subdomains when the url's path starts with the rule's path. The longest rule (host and
    path together) wins; of equally long ones that with the longer host, then the smaller verdict. Without a fitting
    rule ``rule`` is null and the verdict is ``default``. A null url, or one without ``://``, has an empty host and path.
    Rules with a null or empty host are ignored; a null path is an empty one; repeated rules count once; repeated pages
    are judged each; other columns of ``pages`` are not carried. An empty table gives an empty result.

    Each distinct (host, path) is expanded once, only to the label counts and path lengths that rules have, so the
    expansion is bounded by the rule shapes and not by the length of a url. The planner broadcasts prefixes or rules if they are
    below its own size threshold and shuffles both sides otherwise. Pages without a host are not shuffled, and frequent urls
    are not gathered (``join_back``).
    """
    rules = rules.select(
        lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where(F.length("r_host") > 0)
    rules = rules.distinct().select(
        "*", F.concat("r_host", "r_path").alias("r_rule"), F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length")
    )
    shapes: dict[int, list[int]] = {}
    for labels, length in rules.select("labels", "length").distinct().collect():
        shapes.setdefault(labels, []).append(length)
    judged = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = judged.withColumn("place", F.when(F.length("host") > 0, F.concat("host", "path")))
    urls = judged.where("place IS NOT NULL").groupBy("host", "path", "place").agg(F.count("*").alias("n"))
    joined = join_back(judged, materialize(_matches(urls, rules, shapes), "matches").drop("n"), "place", counts=urls.select("place", "n"))
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _digest(expression: str) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [digest.alias("digest"), F.conv(F.substring(digest, 1, HASH_PREFIX), 16, 10).cast("bigint").alias("prefix")]


def _matches(urls: DataFrame, rules: DataFrame, shapes: dict[int, list[int]]) -> DataFrame:
    """(place, n, best) of the urls (host, path, place, n) that some rule fits."""
    labels = F.split("host", r"\.")
    choices = []
    for n, lengths in sorted(shapes.items()):
        suffix = F.when(F.size(labels) >= n, F.substring_index("host", ".", -n))
        choices += [F.when(F.length("path") >= k, F.struct(suffix.alias("suffix"), F.substring("path", 1, k).alias("start"))) for k in sorted(lengths)]
    kind = "array<struct<suffix:string,start:string>>"
    expressions = F.array_compact(F.array(*choices)) if choices else F.array().cast(kind)
    wide = urls.select("place", "n", F.inline(expressions)).where("suffix IS NOT NULL").withColumn("expression", F.concat("suffix", "start"))
    wide = wide.select("place", "n", "suffix", "start", *_digest("expression"))
    known = rules.select("r_host", "r_path", "r_rule", "r_verdict", *_digest("r_rule"))
    near = wide.join(known.select("prefix").distinct(), "prefix", "left_semi")
    met = near.join(known.drop("prefix"), "digest").where((F.col("suffix") == F.col("r_host")) & (F.col("start") == F.col("r_path")))
    rank = F.struct(F.length("r_rule"), F.length("r_host"))
    best = F.max_by(F.struct(F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(rank, F.when(F.col("r_verdict") == "allow", 1).otherwise(0)))
    return met.groupBy("place", "n").agg(best.alias("best"))
