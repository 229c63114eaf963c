"""Positions of regular-expression matches, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def regex_spans(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, value>>``.

    Positions count code points, the end is exclusive. The pieces between matches and the
    matches themselves alternate, so their lengths add up to the positions. ``possible`` is a cheaper
    test that every text with a match passes; texts that fail it skip the pattern.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(pieces, 1, F.size(found)), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    located = F.aggregate(pairs, start, step, lambda state: state["spans"])
    matching = text.rlike(pattern) if possible is None else possible & text.rlike(pattern)
    return F.when(matching, located).otherwise(F.array().cast(f"array<{SPAN}>"))


def tagged(spans: Column, kind: str) -> Column:
    """Spans with the name of their kind in front."""
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
    )


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``."""
    return F.filter(
        spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    )


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Spans by kind (in the order listed) then start, or by start then kind."""

    def key(s: Column) -> Column:
        rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
        first, second = (rank, s["start"].cast("bigint")) if by_kind else (s["start"].cast("bigint"), rank)
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["s"])
