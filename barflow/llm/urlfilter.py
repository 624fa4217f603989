"""URL filter lists by hashed host-suffix and path-prefix expressions.

A rule is a host with a path prefix.  Each distinct URL is expanded into its
host suffixes at label borders (of as many labels as rules have at most) times
its path prefixes of the lengths that rules have; expressions meet rules in an equi-join on the first 32 bits of
their SHA-256, whole digests confirm, and the longest rule (then the longest
host, then blocking before allowing) decides.

Defined results: a null URL or one without `://` has empty host and path and
no rule; URLs without a rule get the default verdict; repeated rows stay;
rules may repeat; empty tables give empty results; other columns may have any
names (host, path, rule and verdict are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sized_broadcast

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host_: Column, path_: Column) -> Column:
    return F.sha2(F.concat(host_, F.lit("\n"), path_).cast("binary"), 256)


def short(full: Column) -> Column:
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.  rules: columns host, path, verdict."""
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).filter("h IS NOT NULL AND p IS NOT NULL").distinct()
    size, most = r.agg(F.coalesce(F.sum(F.length("h") + F.length("p") + 160), F.lit(0)), F.coalesce(F.max(F.size(F.split("h", r"\."))), F.lit(0))).first()
    lengths = [x[0] for x in r.select(F.length("p")).distinct().orderBy(F.length("p")).collect()]  # at most as many as a URL has characters
    r = r.select(digest(F.col("h"), F.col("p")).alias("full"), F.concat("h", "p").alias("rule"), F.length("h").alias("host_length"), "v")
    r = sized_broadcast(r.withColumn("short", short(F.col("full"))), size)

    urls = pages.select(F.col(url).alias("_u")).filter(F.col("_u").isNotNull()).distinct().select("_u", host(F.col("_u")).alias("_h"), path(F.col("_u")).alias("_p")).filter("_h != ''")
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_p")), lambda n: F.substring(F.col("_p"), F.lit(1), n))
    spread = urls.select("_u", F.explode(suffixes).alias("_s"), prefixes.alias("_ps")).select("_u", "_s", F.explode("_ps").alias("_x"))
    spread = spread.withColumn("_full", digest(F.col("_s"), F.col("_x"))).withColumn("short", short(F.col("_full")))
    hits = spread.join(r, "short").filter(F.col("_full") == F.col("full"))
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("v") == "block").alias("blocks"), "rule", "v"))
    key, rule, verdict = fresh(pages, "url", "rule", "verdict")
    verdicts = hits.groupBy("_u").agg(best.alias("_b")).select(F.col("_u").alias(key), F.col("_b.rule").alias(rule), F.col("_b.v").alias(verdict))
    out = pages.join(verdicts, pages[url] == verdicts[key], "left")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*[pages[c] for c in kept], host(pages[url]).alias("host"), path(pages[url]).alias("path"), F.col(rule).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
