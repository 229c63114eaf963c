"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated coordinates make
balanced binary codes that lose little (ITQ). Codes are cut into substrings, one hash table each;
a vector is stored under its own substring and probes all substrings within ``radius`` bits. What
meets is compared by cosine on the original vectors. How many tables there are and how wide they are
is measured for each vector length: partners at the threshold are planted beside sampled vectors, and
tables, from further rotations if one does not do, are added or narrowed until ``RECALL`` of the
partners meet. If nothing narrower does, or a length was not sampled, all vectors of it meet.

A crowded table entry is cut into blocks, and each pair of blocks is a cell of its own, so no task
gets more than two blocks; cells return counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import hash_fraction, stored
from ballast.llm.components import connected_components

TABLES, RADIUS = 4, 1  # tables of the first rotation up to 64 coordinates
TABLE_BITS = (16, 12, 8, 6, 4, 2)
MOST_TABLES = 32  # beyond it narrower tables are tried
RECALL = 0.96  # of planted partners at the threshold
PLANTED_ROWS = 4_000
FIT_ROWS = 20_000
BLOCK_ROWS = 512
CELLS_ROWS = 4_000  # rows a group of cells is meant to hold
ITQ_ROUNDS = 50


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_rotation(sample: np.ndarray, rounds: int = ITQ_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code bits: principal axes, then the ITQ rotation."""
    unit = unit_rows(sample)
    mean = unit.mean(0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
    if len(axes) < sample.shape[1]:
        axes = np.linalg.svd(unit - mean, full_matrices=True)[2]
    projected = (unit - mean) @ axes.T
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(sample.shape[1],) * 2))[0]
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        rotation = (left @ right).T
    return mean, axes.T @ rotation


def planted_partners(unit: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at exactly ``cosine``: moved in any direction, and towards another vector of the sample."""
    rng = np.random.default_rng(11)
    own = unit[rng.permutation(len(unit))[:PLANTED_ROWS]]
    own = np.tile(own, (-(-PLANTED_ROWS // len(own)), 1))[:PLANTED_ROWS]
    pairs = []
    for away in (rng.normal(size=own.shape), unit[rng.integers(0, len(unit), len(own))]):
        away = away - (away * own).sum(1, keepdims=True) * own
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-6
        if some.any():
            pairs.append((own[some], cosine * own[some] + math.sqrt(max(1 - cosine**2, 0.0)) * away[some] / size[some, None]))
    return pairs


def fit_code(sample: np.ndarray, cosine: float, radius: int, tables: int = TABLES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean, and per table the projection whose signs are its bits, so that ``RECALL`` holds at ``cosine``."""
    mean, axes = fit_rotation(sample)
    n = sample.shape[1]
    pairs = planted_partners(unit_rows(sample), cosine)
    rng = np.random.default_rng(13)
    spins = [axes]
    widest = min(TABLE_BITS[0], -(-n // tables))
    for bits in sorted({widest, *(b for b in TABLE_BITS if b < widest)}, reverse=True):
        chosen: list[np.ndarray] = []
        met = [np.zeros(len(u), bool) for u, _ in pairs]
        while len(chosen) < MOST_TABLES:
            at = len(chosen) // -(-n // bits)
            if at == len(spins):
                spins.append(axes @ np.linalg.qr(rng.normal(size=(n, n)))[0])
            part = np.array_split(np.arange(n), -(-n // bits))[len(chosen) % -(-n // bits)]
            chosen.append(spins[at][:, part])
            for kind, (u, v) in enumerate(pairs):
                apart = ((u - mean) @ chosen[-1] >= 0) != ((v - mean) @ chosen[-1] >= 0)
                met[kind] |= apart.sum(1) <= radius
            if len(chosen) >= min(tables, -(-n // bits)) and all(m.mean() >= RECALL for m in met):
                return mean, chosen
    return everything(n)


def everything(n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A code that is the same for all vectors, so that all of them meet."""
    return np.zeros(n), [np.zeros((n, 1))]


def packed(bits: np.ndarray) -> np.ndarray:
    """One integer for each row of bits."""
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64))


def encode(valid: DataFrame, fit_rows: int, tables: int, radius: int, cosine: float) -> DataFrame:
    """``valid`` with ``codes array<bigint>`` and ``widths array<int>`` by table.

    One code per vector length, fitted on at most ``fit_rows`` vectors drawn by a hash of their
    content. Vectors of a length that the sample lacks all share one code.
    """
    rows = valid.count()
    drawn = valid.where(hash_fraction(F.col("vector")) <= min(1.0, 1.2 * fit_rows / max(rows, 1))).select("vector").limit(fit_rows)
    by_size: dict[int, list] = {}
    for row in drawn.toLocalIterator():
        by_size.setdefault(len(row["vector"]), []).append(row["vector"])
    fitted = {n: fit_code(np.array(v, float), cosine, radius, tables) for n, v in by_size.items() if len(v) > 1}
    spread = valid.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            codes: list = [None] * len(vectors)
            widths: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for n in np.unique(sizes):
                where = np.flatnonzero(sizes == n)
                own = unit_rows(np.array([vectors[i] for i in where], float))
                mean, axes = spread.value.get(int(n)) or everything(int(n))
                parts = [packed((own - mean) @ a >= 0) for a in axes]
                width = [a.shape[1] for a in axes]
                for j, i in enumerate(where):
                    codes[i] = [int(p[j]) for p in parts]
                    widths[i] = width
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.list_(pa.int64())), pa.array(widths, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes", "widths"]
            )

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in valid.schema.fields)
    return valid.mapInArrow(run, f"{kind}, codes array<bigint>, widths array<int>")


def link_cell(rows: np.ndarray, left: np.ndarray, vectors: np.ndarray, codes: np.ndarray, table: int, radius: int, cosine: float) -> tuple:
    """Counts of links and a spanning link per row of one cell: ``(counts, roots)``.

    ``left`` marks the stored rows of the cell's first block, the others are asking. A pair counts
    here only if the left row number is the smaller and no earlier table brings the pair together.
    """
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    i, j = np.nonzero(vectors[a] @ vectors[b].T >= cosine)
    i, j = a[i], b[j]
    keep = rows[i] < rows[j]
    i, j = i[keep], j[keep]
    for t in range(table):
        apart = np.bitwise_count(codes[i, t] ^ codes[j, t]) > radius
        i, j = i[apart], j[apart]
    counts = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
    order = np.argsort(rows, kind="stable")
    root = np.empty(len(rows), np.int64)
    root[order] = np.arange(len(rows))
    while len(i):  # every row takes the smallest root in its reach
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[order[root]] if len(root) else root
        if np.array_equal(before, root):
            break
    return counts, rows[order[root]]


def link_embeddings(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    cosine: float = 0.93,
    tables: int = TABLES,
    radius: int = RADIUS,
    fit_rows: int = FIT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per input row.

    Vectors are compared only within equal labels and equal lengths; NULL labels, NULL or empty or
    zero vectors and vectors with NULL or non-finite components link with nothing. Rows without a
    key are linked like others but never name a component; a component without any key has a NULL
    id, and rows without a key are kept only if nothing links to them. Rows that repeat a key
    count as separate vectors.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    # -0.0 becomes 0.0, so that the sum of squares alone decides
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    good = F.coalesce(finite & (size > 0) & (size < float("inf")), F.lit(False))
    grouping = F.col(f"`{label}`").cast("string") if label else F.lit("")
    given = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.when(good & grouping.isNotNull(), grouping).alias("label"), x.alias("vector")
        ),
        "vectors",
    )
    valid = given.where(F.col("label").isNotNull()).select("row", "label", "vector")
    coded = stored(encode(valid, fit_rows, tables, radius, cosine), "codes")

    def posting(code) -> F.Column:
        return F.xxhash64("label", F.size("vector"), "table", code)

    placed = coded.select("row", "label", "vector", F.posexplode("codes").alias("table", "code"), "widths").select(
        "row", "label", "vector", "table", "code", F.get("widths", F.col("table")).alias("width")
    )
    own = placed.select("row", "table", posting(F.col("code")).alias("posting"), F.lit(1).alias("own"))
    asked = own
    if radius:
        flips = probe_masks(radius)
        asked = own.unionByName(placed.select("row", "table", F.explode(flips).alias("flip"), "label", "vector", "code").select(
            "row", "table", posting(F.col("code").bitwiseXOR(F.col("flip"))).alias("posting"), F.lit(0).alias("own")))
    size = asked.groupBy("posting").agg(F.sum("own").alias("n_own"), F.count("*").alias("n")).where("n_own > 0 and n > 1")
    met = asked.join(size, "posting")
    blocks = F.ceil(F.col("n_own") / block_rows).cast("int")
    askers = F.ceil(F.col("n") / block_rows).cast("int")
    mine = met.withColumn("blocks", blocks).withColumn("askers", askers)
    spot = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    stored_side = mine.where("own = 1").select("row", "table", "posting", F.lit(True).alias("left"), spot(F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("j"))
    asking_side = mine.select("row", "table", "posting", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), spot(F.col("askers")).alias("j"))
    sides = stored(stored_side.unionByName(asking_side), "cells")
    groups = max(1, sides.count() // CELLS_ROWS)
    cell = F.xxhash64("posting", "i", "j")
    work = sides.select("row", "table", "left", cell.alias("cell"), F.pmod(cell, F.lit(groups)).alias("group")).join(coded.select("row", "vector", "codes"), "row")

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["cell"].to_numpy(), kind="stable")
        cells = frame["cell"].to_numpy()[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
        rows, left, table = (frame[c].to_numpy()[order] for c in ("row", "left", "table"))
        own, codes = frame["vector"].to_numpy()[order], frame["codes"].to_numpy()[order]
        out = []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            side = left[start:stop].astype(bool)
            if side.all() or not side.any():
                continue
            unit = unit_rows(np.array(own[start:stop].tolist(), float))
            part = rows[start:stop]
            counts, roots = link_cell(part, side, unit, np.array(codes[start:stop].tolist(), np.int64), int(table[start]), radius, cosine)
            some = counts > 0
            out.append(pd.DataFrame({"row": part[some], "links": counts[some], "root": roots[some]}))
        return pd.concat(out) if out else pd.DataFrame({"row": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})

    linked = stored(work.groupBy("group").applyInPandas(measure, "row bigint, links bigint, root bigint"), "links")
    degree = linked.groupBy("row").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("row").alias("a"), F.col("root").alias("b")))
    full = given.select("row", "id").join(degree, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    full = stored(full.select("row", "id", "links", F.coalesce("root", "row").alias("component")), "linked")
    names = full.groupBy("component").agg(F.min("id").alias("name"))
    return full.join(names, "component").select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"),
        F.col("name").cast("bigint").alias("component_id"),
        F.coalesce(F.col("id") == F.col("name"), F.col("links").isNull()).alias("kept"),
    )


def probe_masks(radius: int) -> F.Column:
    """Bit masks of 1 to ``radius`` flipped bits for a substring of ``width`` bits."""
    one = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda b: F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), b).cast("bigint"))
    masks = one
    for _ in range(radius - 1):
        masks = F.array_distinct(F.concat(one, F.flatten(F.transform(masks, lambda m: F.transform(one, lambda o: m.bitwiseXOR(o))))))
    return F.filter(masks, lambda m: m != 0)
