"""URL filters: host-suffix and path-prefix expressions joined to rules on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", hex_digits: int = 8) -> DataFrame:
    """Judge each row of pages(page_id, url) by rules(host, path, verdict).

    Every URL is expanded into (host suffix + path prefix) expressions, only of the label counts and
    prefix lengths that occur in the rules. Their SHA-256 digests are equi-joined to the rules on
    the first `hex_digits` digits; the full digests confirm a match. The longest rule wins; `block`
    wins over `allow` between equal ones.

    A null URL or one without `://` has empty host and path. A path that is empty starts with no
    rule's path but the empty one. Rows where no rule fits get `rule` null and the `default` verdict.
    Every row of pages is returned once, repeated ones too; an empty table gives an empty result.
    Rules with a null part fit nothing. Other columns of either table are ignored.

    Returns page_id, host, path, rule, verdict.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    # a few small sets, of rule shapes and not of rules
    shapes = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    rule_table = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.sha2(F.concat("host", "path"), 256).alias("rule_digest")
    ).withColumn("short", F.substring("rule_digest", 1, hex_digits))

    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(
        *(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in range(1, (shapes["labels"] or 0) + 1)),
        F.lit(None).cast("string"),
    ))
    prefixes = F.array_compact(F.array(
        *(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes["lengths"] or [])),
        F.lit(None).cast("string"),
    ))
    expressions = (
        rows.where(F.col("url").contains("://"))
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("expression", F.concat("suffix", "prefix"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, hex_digits))
    )
    fits = expressions.join(rule_table, "short").where(F.col("digest") == F.col("rule_digest"))
    judged = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))).alias("best")
    )
    return rows.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
