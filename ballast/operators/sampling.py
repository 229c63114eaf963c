"""Rebalancing of classes: cost weights, under-sampling, synthetic over-sampling, link cleaning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_order, hash_slot, hash_unit
from ballast.operators.columns import quoted
from ballast.operators.knn import BLOCK_ROWS, knn_join, tomek_links, tomek_links_within
from ballast.operators.skew import join_unique
from ballast.operators.splitting import count_classes, first_ranks
from ballast.session import materialize

NEIGHBORS = 3
CHUNK = 1_000  # synthetic rows made from one base row by one task at a time
# The weight rules a cost-sensitive model is tuned over.
COST_GRID = [None, "balanced", {0: 1, 1: 5}, {0: 1, 1: 10}]


def weight_expression(
    counts: Mapping[object, int], rule: str | Mapping[int, float] | None, target: str = "target"
) -> Column:
    """The weight of a row under a rule: none, inverse class frequency, or a weight per class."""
    if rule is None:
        return F.lit(1.0)
    if rule == "balanced":
        total = sum(counts.values())
        weights = {g: total / (len(counts) * n) for g, n in counts.items()}
    else:
        unknown = [g for g in rule if g not in counts]
        if unknown:
            raise ValueError(f"the weights name {unknown}, but the classes are {sorted(counts, key=str)}")
        weights = {g: float(rule.get(g, 1.0)) for g in counts}
    weight = F.lit(1.0)
    for g, w in weights.items():
        weight = F.when(quoted(target) == F.lit(g), F.lit(float(w))).otherwise(weight)
    return weight


def class_weights(
    df: DataFrame, rule: str | Mapping[int, float] | None, target: str = "target", name: str = "weight"
) -> DataFrame:
    """Add a weight column for a training algorithm."""
    counts = count_classes(df, target) if rule is not None else {}
    return df.withColumn(name, weight_expression(counts, rule, target))


def random_under_sample(df: DataFrame, seed: int, row_id: str = "row_id", target: str = "target") -> DataFrame:
    """Every class cut to the size of the smallest, by the order of a seeded hash."""
    counts = count_classes(df, target)
    least = min(counts.values())
    digest = hash_order(seed, quoted(row_id))
    larger = {g: least for g, n in counts.items() if n > least}
    if not larger:
        return df
    whole = quoted(target).isin([g for g in counts if g not in larger])
    return df.where(whole | first_ranks(df.where(~whole), larger, digest, target))


def smote_samples(
    points: DataFrame,
    need: int,
    seed: int,
    k: int = NEIGHBORS,
    row_id: str = "row_id",
    vector: str = "x",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``need`` new points on segments between rows of one class and their k nearest.

    Every row is the base of equally many points; what is left over goes to the
    first rows in hash order. Which neighbour, and where on the segment, come from
    the hash of (seed, row, copy). Returns ``(base_id, copy, neighbor_id, fraction, x)``.
    """
    points, near = class_neighbors(points, k, row_id, vector, block_rows)
    return segment_points(points, near, need, seed).drop("reach")


def class_neighbors(points: DataFrame, k: int, row_id: str, vector: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of one class as ``(row_id, x)``, and the k nearest of each."""
    points = materialize(points.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("x")))
    n = points.count()
    if n <= k:
        raise ValueError(f"over-sampling with {k} neighbours needs more than {k} rows, got {n}")
    return points, materialize(knn_join(points, k, block_rows=block_rows))


def segment_points(points: DataFrame, near: DataFrame, need: int, seed: int) -> DataFrame:
    """The new points of :func:`smote_samples`, with ``reach``, their distance from their base."""
    n = points.count()
    ends = points.select(F.col("row_id").alias("neighbor_id"), F.col("x").alias("end"))
    lists = (
        join_unique(near, ends, "neighbor_id")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "end"))).alias("near"))
    )
    each, left = divmod(need, n)
    extra = F.lit(0)
    if left:
        one_class = points.withColumn("_one", F.lit(1))
        extra = first_ranks(one_class, {1: left}, hash_order(f"{seed}:extra", F.col("row_id")), "_one").cast("int")
    bases = points.withColumn("_one", F.lit(1)).withColumn("copies", F.lit(each) + extra).where("copies > 0")
    bases = bases.drop("_one").join(lists, "row_id")
    start = F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(CHUNK))).alias("start")
    # Few bases may make many points: the chunks are spread, not the bases.
    chunks = bases.select("row_id", "x", "near", "copies", start).repartition("row_id", "start")
    stop = F.least(F.col("start") + CHUNK, F.col("copies")) - 1
    copies = chunks.select("row_id", "x", "near", F.explode(F.sequence("start", stop)).alias("copy"))
    digest = hash_order(seed, F.col("row_id"), F.col("copy"))
    drawn = copies.select(
        F.col("row_id").alias("base_id"),
        "copy",
        "x",
        F.col("near")[hash_slot(digest, F.size("near")).cast("int")].alias("to"),
        hash_unit(F.substring(digest, 9, 8)).alias("fraction"),
    )
    moved = drawn.withColumn("moved", F.zip_with("x", "to.end", lambda a, b: a + F.col("fraction") * (b - a)))
    square = F.aggregate(F.zip_with("moved", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v)
    return moved.select(
        "base_id", "copy", F.col("to.neighbor_id").alias("neighbor_id"), "fraction", F.col("moved").alias("x"), F.sqrt(square).alias("reach")
    )


def smote(
    df: DataFrame,
    seed: int,
    k: int = NEIGHBORS,
    row_id: str = "row_id",
    vector: str = "x",
    target: str = "target",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill every smaller class up to the largest with synthetic rows.

    Returns ``(row_id, x, target, synthetic)`` with text ids; a synthetic row is
    called ``<base>#<copy>``.
    """
    return filled_up(df, count_classes(df, target), seed, k, row_id, vector, target, block_rows)[0].drop("reach")


def filled_up(
    df: DataFrame, counts: Mapping[object, int], seed: int, k: int, row_id: str, vector: str, target: str, block_rows: int
) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of :func:`smote` with ``reach``, a distance within which a new row has its base; and for each
    class filled up the same of its own rows, ``(row_id, reach)``, the distance of the nearest in the class."""
    most = max(counts.values())
    out = df.select(
        F.col(row_id).cast("string").alias("row_id"),
        F.col(vector).cast("array<double>").alias("x"),
        F.col(target).alias("target"),
        F.lit(False).alias("synthetic"),
        F.lit(None).cast("double").alias("reach"),
    )
    known = []
    for label, n in sorted(counts.items()):
        if n < most:
            points, near = class_neighbors(df.where(quoted(target) == F.lit(label)), k, row_id, vector, block_rows)
            made = segment_points(points, near, most - n, seed)
            out = out.unionByName(
                made.select(
                    F.concat(F.col("base_id").cast("string"), F.lit("#"), F.col("copy").cast("string")).alias("row_id"),
                    "x",
                    F.lit(label).cast(df.schema[target].dataType).alias("target"),
                    F.lit(True).alias("synthetic"),
                    "reach",
                )
            )
            known.append(near.where("rank = 1").select(F.col("row_id").cast("string").alias("row_id"), F.col("distance").alias("reach")))
    return out, known


def clean_tomek(
    df: DataFrame,
    remove: str = "both",
    row_id: str = "row_id",
    vector: str = "x",
    target: str = "target",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Drop the rows of Tomek links: both ends, or the end in the larger class."""
    links = tomek_links(df, row_id, vector, target, block_rows)
    if remove == "both":
        return without_ends(df, links, row_id)
    if remove != "majority":
        raise ValueError("remove must be 'both' or 'majority'")
    counts = count_classes(df, target)
    least = min(counts, key=lambda g: (counts[g], g))
    larger = df.where(quoted(target) != F.lit(least)).select(row_id)
    return without_ends(df, links, row_id, larger)


def without_ends(df: DataFrame, links: DataFrame, row_id: str = "row_id", among: DataFrame | None = None) -> DataFrame:
    """The rows that no link ends in; ends not ``among`` the given ids stay."""
    ends = links.select(F.explode(F.array("low_id", "high_id")).alias(row_id))
    if among is not None:
        ends = ends.join(among, row_id, "left_semi")
    return df.join(ends.distinct(), row_id, "left_anti")


def smote_tomek(
    df: DataFrame,
    seed: int,
    k: int = NEIGHBORS,
    row_id: str = "row_id",
    vector: str = "x",
    target: str = "target",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Synthetic over-sampling, then removal of both ends of every Tomek link.

    The search that over-sampling makes already tells every row of a filled class, and every new row, how far
    its nearest can be; only those rows, and the few of the largest class that they name, search the filled
    table. Where several classes are largest no distance is known for their rows, and all rows search.
    """
    counts = count_classes(df, target)
    filled, known = filled_up(df, counts, seed, k, row_id, vector, target, block_rows)
    filled = materialize(filled)
    rows = filled.drop("reach")
    if not known or len(counts) - len(known) > 1:
        return clean_tomek(rows, "both", block_rows=block_rows)
    reach = filled.where("synthetic").select("row_id", "reach")
    for part in known:
        reach = reach.unionByName(part)
    links = tomek_links_within(rows, reach, block_rows=block_rows)
    return without_ends(rows, links)
