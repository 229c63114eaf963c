"""Secret scans in built-in functions only: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over ASCII characters are trained from labelled samples: values
that the fixed patterns found (random strings) and ordinary words (identifiers). A long token is
a secret if the random model explains it better by ``margin`` nats.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import hash_fraction
from ballast.llm.spans import ordered, outside, regex_spans, tagged

KINDS = ["assign", "access", "hex", "random"]
# The patterns are part of the contract. Bounded repeats and possessive forms match
# the same strings as the plain ones, without trying every start inside a run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{32,}+"
TOKEN = r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_=-]{20,}+"
WORD = r"[A-Za-z0-9_]{6,}+"
CODES = 128
SYMBOLS = 68  # letters, digits and + / _ . = -
BACKOFF = 5.0  # weight of single characters against pairs, in observations


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of random against ordinary, by pairs of ASCII codes (row-major)."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        text = ",".join(format(r, ".5g") for r in self.ratios)
        return F.split(F.lit(text), ",").cast("array<double>")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns as ``array<struct<kind, start, end, value>>``."""
    assign = F.filter(regex_spans(text, ASSIGN, text.rlike("[:=]")), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8)
    access = regex_spans(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = regex_spans(text, HEX, text.rlike("[0-9a-f]{32}"))
    return F.concat(tagged(assign, "assign"), tagged(access, "access"), tagged(hexes, "hex"))


def character_pairs(token: Column) -> Column:
    """``code1 * 128 + code2`` of all neighbouring characters of an ASCII token."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)), lambda a, b: a * CODES + b)


def train_markov(documents: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = 5_000) -> MarkovModel:
    """Fit both models on a sample of about ``sample_rows`` documents, chosen by a hash of ``key``.

    Labels come from the fixed patterns: the distinct values they find are random strings, the
    distinct words outside them (taken from about 1,000 documents) ordinary ones. At most
    2 x 128 x 128 counts reach the driver.
    """
    rows = documents.count()
    share = min(1.0, sample_rows / max(rows, 1))
    draw = hash_fraction(F.col(f"`{key}`"))
    sample = (
        documents.where(draw <= share)
        .select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), (hash_fraction(F.lit("words"), F.col(f"`{key}`")) < 0.2).alias("few"))
    )
    found = sample.select(F.explode(base_spans(F.col("t"))).alias("s"))
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value"))
    secrets = found.select(F.lit(1).alias("random"), value.alias("token"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.where("few").select(F.lit(0).alias("random"), F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("token"))
    counts = (
        secrets.unionByName(words)
        .distinct()
        .select("random", F.explode(character_pairs(F.col("token"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    tables = [[0.0] * (CODES * CODES) for _ in range(2)]
    before = [[0.0] * CODES for _ in range(2)]
    after = [[0.0] * CODES for _ in range(2)]
    for row in counts:
        first, second = divmod(row["pair"], CODES)
        tables[row["random"]][row["pair"]] += row["count"]
        before[row["random"]][first] += row["count"]
        after[row["random"]][second] += row["count"]
    sums = [sum(a) for a in after]

    def log_likelihood(kind: int, pair: int) -> float:
        first, second = divmod(pair, CODES)
        # What rarely or never follows a character backs off to how frequent it is at all.
        alone = (after[kind][second] + 0.5) / (sums[kind] + 0.5 * SYMBOLS)
        return math.log((tables[kind][pair] + BACKOFF * alone) / (before[kind][first] + BACKOFF))

    return MarkovModel(tuple(log_likelihood(1, p) - log_likelihood(0, p) for p in range(CODES * CODES)))


def random_spans(text: Column, ratios: Column, margin: float) -> Column:
    """Long tokens that the model of random strings explains better by ``margin`` nats."""

    def ratio(span: Column) -> Column:
        return F.aggregate(character_pairs(span["value"]), F.lit(0.0), lambda sum_, pair: sum_ + F.get(ratios, pair))

    return F.filter(tagged(regex_spans(text, TOKEN), "random"), lambda s: ratio(s) >= margin)


def scan_secrets(documents: DataFrame, model: MarkovModel, text: str = "text", out: str = "secrets", margin: float = 10.0) -> DataFrame:
    """``documents`` with ``out``: all spans by start, then kind; code points, end exclusive.

    Spans of the fixed patterns always stay; spans of the models are added where they overlap
    none of them. NULL and empty texts have no spans. Repeated rows are scanned each for itself.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = documents.withColumn(out, base_spans(body))
    added = outside(random_spans(body, model.column(), margin), F.col(out))
    return base.withColumn(out, ordered(F.concat(F.col(out), added), KINDS, by_kind=False))
