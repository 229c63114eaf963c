"""Ids for rows that have no key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.operators.columns import quoted
from ballast.session import materialize

SENT_KEYS = 1 << 18  # digests that all tasks may be told


def row_digest(columns: list[str]) -> Column:
    """A digest of the texts of all columns; lengths and a mark for NULL keep different rows apart."""
    texts = [quoted(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("N")) for t in texts]))


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique text id: the digest of the row, and ``#1``, ``#2``... behind it where rows are equal.

    One pass counts the digests by 64 bits of them. Rows whose bits occur once are done and are not
    shuffled, unless the bits that occur more often are too many to broadcast. The others are first
    counted where they lie, so that a row repeated in a third of the table is numbered by many tasks.
    """
    named = df.withColumn(name, row_digest(df.columns))
    bits = F.xxhash64(quoted(name)).alias("_bits")
    repeated = named.groupBy(bits).agg(F.count("*").alias("_n")).where("_n > 1").select("_bits")
    repeated = materialize(repeated)
    n = repeated.count()
    if not n:
        return named
    if n <= SENT_KEYS:
        repeated = F.broadcast(repeated)
    marked = named.select("*", bits)
    single = marked.join(repeated, "_bits", "left_anti")
    copies = marked.join(repeated, "_bits", "left_semi").withColumn("_place", F.spark_partition_id())
    copies = materialize(copies)  # places must not move between the two uses below
    before = copies.groupBy(name, "_place").agg(F.count("*").alias("_n"))
    of_name = Window.partitionBy(name)
    earlier = of_name.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(
        quoted(name), "_place", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(of_name).alias("_copies")
    )
    within = F.row_number().over(Window.partitionBy(name, "_place").orderBy(F.lit(1)))
    numbered = copies.withColumn("_within", within).join(before, [name, "_place"])
    number = F.concat(quoted(name), F.lit("#"), (F.col("_before") + F.col("_within")).cast("string"))
    # Different digests may share their bits.
    numbered = numbered.withColumn(name, F.when(F.col("_copies") > 1, number).otherwise(quoted(name)))
    return single.select(*map(quoted, named.columns)).unionByName(numbered.select(*map(quoted, named.columns)))
