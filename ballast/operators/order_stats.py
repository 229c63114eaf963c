"""Exact ranks of a distributed column without a global sort or a one-task window.

Both searches below narrow in on the wanted ranks by counting rows per bucket, one
aggregation per round, and look only inside the bucket that holds the rank in the
next round. A round returns a bounded number of bucket counts to the driver, never
rows of the table, and a hot value ends its search early because its bucket has
equal ends.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ballast.functions.numeric import missing_to_null
from ballast.operators.columns import quoted

PREFIX = 3  # hex digits per round of the hash search: 4096 buckets
FETCH = 4096  # a bucket this small is read out instead of split further
BUCKETS = 1024  # buckets per round of the value search
DIGEST = 32  # hex digits of a digest


def hash_thresholds(
    df: DataFrame, group: str, digest: Column, ranks: Mapping[object, Sequence[int]]
) -> dict[object, dict[int, str]]:
    """The digest at each wanted rank (from 1) of each group, in digest order.

    ``digest`` is a hex text, distinct per row. A row belongs to the first ``r`` of
    its group exactly if its digest is not above the threshold of ``r``, so callers
    select with a filter and need no shuffle. Raises if rows share the digest at a
    threshold, because no threshold could then select exactly ``r`` of them.
    """
    hashed = df.select(quoted(group).alias("g"), digest.alias("h"))
    found: dict[object, dict[int, str]] = {g: {} for g in ranks}
    # (group, rank, digits known so far, rank within the rows that share them)
    open_searches = [(g, r, "", r) for g, wanted in ranks.items() for r in sorted(set(wanted)) if r > 0]
    while open_searches:
        depth = len(open_searches[0][2])
        scope = hashed
        if depth:
            scope = hashed.where(_any_of({(g, p) for g, _, p, _ in open_searches}, depth))
        else:
            scope = hashed.where(_group_in({g for g, *_ in open_searches}))
        counts = (
            scope.groupBy("g", F.substring("h", 1, depth + PREFIX).alias("p"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        table: dict[tuple, list[tuple[str, int]]] = {}
        for row in counts:
            table.setdefault((row.g, row.p[:depth]), []).append((row.p, row.n))
        for buckets in table.values():
            buckets.sort()
        split, small = [], []
        for g, rank, prefix, within in open_searches:
            left = within
            for p, n in table.get((g, prefix), []):
                if left <= n:
                    if n > FETCH and len(p) >= DIGEST:
                        raise ValueError(f"{n} rows of group {g!r} share one id: ids must be unique")
                    (small if n <= FETCH else split).append((g, rank, p, left))
                    break
                left -= n
            else:
                raise ValueError(f"rank {rank} is beyond the rows of group {g!r}")
        if small:
            rows = hashed.where(_any_of({(g, p) for g, _, p, _ in small}, depth + PREFIX)).collect()
            members: dict[tuple, list[str]] = {}
            for row in rows:
                members.setdefault((row.g, row.h[: depth + PREFIX]), []).append(row.h)
            for digests in members.values():
                digests.sort()
            for g, rank, p, left in small:
                digests = members[(g, p)]
                if left < len(digests) and digests[left] == digests[left - 1]:
                    raise ValueError(f"rows of group {g!r} share an id at rank {rank}: ids must be unique")
                found[g][rank] = digests[left - 1]
        open_searches = split
    return found


def _group_in(groups) -> Column:
    return F.col("g").isin(list(groups))


def _any_of(pairs: set[tuple], depth: int) -> Column:
    by_group: dict[object, list[str]] = {}
    for g, p in pairs:
        by_group.setdefault(g, []).append(p)
    condition = F.lit(False)
    for g, prefixes in by_group.items():
        condition = condition | ((F.col("g") == F.lit(g)) & F.substring("h", 1, depth).isin(sorted(prefixes)))
    return condition


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(c, v)``: position of the column and value, NULL where missing (NULL or NaN).

    One narrow plan serves any number of columns, where an aggregate per column
    would outgrow generated code; partial aggregation keeps the shuffle at one row
    per column and task.
    """
    cells = [
        F.struct(F.lit(i).alias("c"), missing_to_null(quoted(c).cast("double")).alias("v")) for i, c in enumerate(columns)
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.c", "cell.v")


def column_summaries(df: DataFrame, columns: Sequence[str]) -> dict[int, Row]:
    """By position of the column: counts, moments and finite extremes of its values, in one pass."""
    v = F.col("v")
    finite = F.abs(v) < float("inf")
    rows = long_values(df, columns).groupBy("c").agg(
        F.count("v").alias("n"),
        F.count("*").alias("total"),
        F.avg("v").alias("mean"),
        F.var_pop("v").alias("variance"),
        F.count_if(v == float("-inf")).alias("below"),
        F.count_if(v == float("inf")).alias("above"),
        F.min(F.when(finite, v)).alias("low"),
        F.max(F.when(finite, v)).alias("high"),
    )
    return {r.c: r for r in rows.collect()}


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interpolation: str = "linear",
    summaries: Mapping[int, Row] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, missing values (NULL and NaN) ignored.

    The search over bucket counts serves all columns in the same round and holds no
    values, whatever the size of the table. Infinities are counted beforehand and
    stay out of the search, because no bucket width reaches them. ``summaries`` saves the pass
    that finds the extremes.
    """
    values = long_values(df, columns)
    finite = F.abs(F.col("v")) < float("inf")
    ends = column_summaries(df, columns) if summaries is None else summaries
    wanted: dict[int, set[int]] = {}
    found: dict[int, dict[int, float]] = {i: {} for i in ends}
    for i, e in ends.items():
        for rank in {rank for p in probabilities for rank in _ranks(p, e.n, interpolation)} if e.n else ():
            if rank <= e.below:
                found[i][rank] = float("-inf")
            elif rank > e.n - e.above:
                found[i][rank] = float("inf")
            else:
                wanted.setdefault(i, set()).add(rank - e.below)
    searched = _values_at(values.where(finite), wanted, {i: (ends[i].low, ends[i].high) for i in wanted})
    for i, by_rank in searched.items():
        found[i].update((rank + ends[i].below, value) for rank, value in by_rank.items())
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        n = ends[i].n if i in ends else 0
        out[c] = [_blend(found[i], p, n, interpolation) if n else None for p in probabilities]
    return out


def _ranks(p: float, n: int, interpolation: str) -> list[int]:
    position = p * (n - 1)
    if interpolation == "nearest":
        return [math.floor(position + 0.5) + 1]
    return [math.floor(position) + 1, math.ceil(position) + 1]


def _blend(found: dict[int, float], p: float, n: int, interpolation: str) -> float:
    ranks = _ranks(p, n, interpolation)
    if len(ranks) == 1 or found[ranks[0]] == found[ranks[1]]:
        return found[ranks[0]]
    share = p * (n - 1) - math.floor(p * (n - 1))
    return found[ranks[0]] * (1 - share) + found[ranks[1]] * share


def _values_at(
    values: DataFrame, wanted: Mapping[int, set[int]], ends: Mapping[int, tuple[float, float]]
) -> dict[int, dict[int, float]]:
    """The value at each rank (from 1) of each column, by narrowing value ranges."""
    found: dict[int, dict[int, float]] = {i: {} for i in wanted}
    # (column, low, high) -> [(rank, rank within the range)]
    ranges = {(i, *ends[i]): [(r, r) for r in sorted(ranks)] for i, ranks in wanted.items()}
    while ranges:
        for (i, low, high), searches in list(ranges.items()):
            if low == high:
                found[i].update((rank, low) for rank, _ in searches)
                del ranges[(i, low, high)]
        if not ranges:
            break
        counts = _bucket_counts(values, list(ranges))
        narrowed: dict[tuple, list[tuple[int, int]]] = {}
        for key, searches in ranges.items():
            for rank, left in searches:
                for _, n, low, high in counts[key]:
                    if left <= n:
                        if left in (1, n):  # the ends of a bucket are known
                            found[key[0]][rank] = low if left == 1 else high
                        else:
                            narrowed.setdefault((key[0], low, high), []).append((rank, left))
                        break
                    left -= n
        ranges = narrowed
    return found


def _bucket_counts(values: DataFrame, keys: list[tuple]) -> dict[tuple, list[tuple]]:
    """Per range its non-empty buckets in order: (bucket, rows, lowest, highest)."""
    table = values.sparkSession.sql(
        "select * from values "
        + ", ".join(f"({i}, {slot}, double('{low!r}'), double('{high!r}'))" for slot, (i, low, high) in enumerate(keys))
        + " as ranges(c, slot, low, high)"
    )
    # One row per open range: at most two ranks per column and probability.
    inside = values.join(F.broadcast(table), "c").where(F.col("v").between(F.col("low"), F.col("high")))
    rows = (
        inside.groupBy("slot", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("b"))
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )
    out: dict[tuple, list[tuple]] = {key: [] for key in keys}
    for r in rows:
        out[keys[r.slot]].append((r.b, r.n, r.low, r.high))
    for buckets in out.values():
        buckets.sort()
    return out


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Monotone bucket number in which ``low`` and ``high`` differ."""
    # Halves, because the difference of two large values of opposite sign overflows.
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(value == high, BUCKETS).when(high / 2 == low / 2, 0).otherwise(F.floor(share * BUCKETS)).cast("int")
