"""URL verdicts from host and path rules, in built-in functions only.

Each distinct URL is expanded into the host-suffix and path-prefix expressions that some rule
could equal. Expressions meet rules by the first 32 bits of their SHA-256; the full digest then
confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import ascii_lower


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, ascii_lower(raw)).otherwise(""), F.when(known, path).otherwise("")


def short_key(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns so named are replaced.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains of
    it if the path of the URL starts with the rule's. The rule whose host and path are longest
    together wins; ties go to the longer host, then to ``block``. URLs that no rule fits get
    ``rule`` NULL and the verdict ``default``. Rules with a NULL are ignored. Repeated and NULL
    URLs keep all their rows.
    """
    own = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("link"))
    stated = rules.select("host", "path", "verdict").dropna().distinct()
    shape = stated.agg(
        F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("sizes")
    ).first()
    labels, sizes = sorted(shape["labels"]), sorted(shape["sizes"])  # at most as many as the longest rule is long
    parts = F.split(F.col("h"), r"\.", -1)
    suffixes = [
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")) for n in labels
    ]
    prefixes = [F.when(F.length("p") >= n, F.substring(F.col("p"), 1, n)) for n in sizes]
    links = own.select(F.col(f"`{url}`").alias("link")).where(F.col("link").isNotNull()).distinct()
    expanded = (
        links.select("link", host.alias("h"), path.alias("p"))
        .select("link", F.array(*suffixes).cast("array<string>").alias("hs"), F.array(*prefixes).cast("array<string>").alias("ps"))
        .select("link", "ps", F.explode(F.array_compact("hs")).alias("rule_host"))
        .select("link", "rule_host", F.explode(F.array_compact("ps")).alias("rule_path"))
        .withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
        .withColumn("key", short_key(F.col("digest")))
    )
    digest = F.sha2(F.concat("host", "path"), 256)
    table = stated.select(
        short_key(digest).alias("key"),
        digest.alias("rule_digest"),
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_size"),
    )
    fits = expanded.join(table, "key").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule").alias("a"), F.col("host_size").alias("b"), (F.col("verdict") == "block").alias("c"))
    best = fits.groupBy("link").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    # The hash beside the URL makes both sides exchange anew, so that a frequent URL can be split.
    keyed = own.withColumn("link", F.col(f"`{url}`")).withColumn("link_hash", F.xxhash64("link"))
    joined = keyed.join(best.withColumn("link_hash", F.xxhash64("link")), ["link_hash", "link"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in own.columns],
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
