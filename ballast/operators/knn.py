"""Exact k nearest neighbours of every row, and the links between them.

Rows are grouped into blocks of bounded size around pivots. Each row first meets
its own block, which bounds how far its k-th neighbour can be. Blocks lie on shelves, many
to one, and a row travels once to each shelf with a cell that the geometry does not rule out
(triangle inequality and the bisecting plane between pivots), whatever the number of blocks
there. Inside a task the rows met are cut into leaves with bounding boxes, and leaves beyond
the best distances so far are passed over. Tables with more blocks than there may be pivots get a
second level: cells are cut again around pivots of their own. Distances are taken leaf by leaf
with NumPy, and a shelf emits at most k + 1 candidates per row, so pairs are never laid out.

Copies of one vector are collapsed first: whichever copy asks, only the k + 1
smallest ids of a vector can be among its neighbours, so a vector repeated in a
third of the table costs no more than a rare one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_order, hash_unit
from ballast.operators.identity import SENT_KEYS
from ballast.operators.skew import HOT_FLOOR, HOT_SHARE
from ballast.session import materialize

# Rows of a block: larger blocks mean fewer trips for each row where nothing can be
# pruned, smaller ones less to measure where much can.
BLOCK_ROWS = 4096
GROUPS_PER_TASK = 64
LEAF_ROWS = 512  # rows whose distances are taken at once inside a task
SHELF_BYTES = 64 << 20  # of vectors on a shelf, and of those that visit it in one task
SHELF_ROWS = 1 << 17
SHELVES = 8  # at least so many, of at least BLOCK_ROWS rows each
MAX_PIVOTS = 2048
ROUNDING = 1e-12  # relative; thousands of times the rounding error of a sum of squares
CLOSE = 1e-9  # relative; loosens the first look at a cell, so that it drops none that the closer look keeps
PIECE_CELLS = 1 << 18  # of a matrix of distances to pivots, held at once
REACH_ROUNDING = 1e-9  # relative; distances handed in may come from another order of summing


def knn_join(
    points: DataFrame,
    k: int,
    row_id: str = "row_id",
    vector: str = "x",
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``(row_id, rank, neighbor_id, distance)``: the k nearest other rows of each row.

    Euclidean distance; equal distances rank by id. Rows get fewer than k neighbours
    only where the table has no more rows. ``max_pivots`` bounds what all tasks know of
    the first level; the second has a pivot for each block, however many there are.
    """
    return ranked(nearest_lists(points, k, row_id, vector, block_rows, max_pivots), k)


def ranked(lists: DataFrame, k: int) -> DataFrame:
    """Lists ``(row_id, near)`` as one row for each of the first ``k`` other rows."""
    others = F.filter("near", lambda c: c["id"] != F.col("row_id"))
    return lists.select("row_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "c")).select(
        F.col("row_id"),
        (F.col("pos") + 1).alias("rank"),
        F.col("c.id").alias("neighbor_id"),
        F.col("c.d").alias("distance"),
    )


def nearest_lists(
    points: DataFrame, k: int, row_id: str, vector: str, block_rows: int, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """Per row the k + 1 rows nearest to its vector, usually with the row itself: ``(row_id, near)``."""
    layout = Layout(points, k, row_id, vector, block_rows, max_pivots)
    return layout.told(search(layout.cells, k, block_rows), layout.rows)


class Layout:
    """The distinct vectors of a table in their cells, for one search or for several with the same ``k``."""

    def __init__(
        self, points: DataFrame, k: int, row_id: str, vector: str, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS
    ):
        self.k, self.block_rows = k, block_rows
        self.rows = points.select(
            F.col(row_id).alias("id"), F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("x")
        ).withColumn("h", F.xxhash64("x"))
        self.distinct = materialize(collapsed(self.rows, k + 1).withColumn("rep", F.col("ids")[0]))
        size = self.distinct.agg(F.count("*").alias("n"), F.max(F.size("ids")).alias("most")).first()
        self.copies = (size["most"] or 1) > 1
        self.cells = assign_cells(self.distinct, size["n"], block_rows, max_pivots)

    def told(self, lists: DataFrame, rows: DataFrame) -> DataFrame:
        """The lists ``(rep, near)`` of vectors, handed to those of ``rows`` that hold them."""
        if not self.copies:
            return lists.withColumnRenamed("rep", "row_id")
        told = materialize(self.distinct.select("rep", "h", "x", F.size("ids").alias("copies")).join(lists, "rep"))
        single = told.where("copies = 1").select(F.col("rep").alias("row_id"), "near")
        return single.unionByName(share_lists(rows, told.where("copies > 1").select("h", "x", "near")))

    def nearest_within(self, asked: DataFrame) -> DataFrame:
        """The lists ``(row_id, near)`` of the rows in ``asked`` only: ``(row_id, reach)``, ids unique.

        ``reach`` is a distance within which the row is known to have ``k`` others, NULL where that is
        not known; it takes the place of the meeting with the own block and decides which cells are
        visited. It may be too small by rounding.
        """
        asked = asked.select(F.col("row_id").alias("id"), F.coalesce(F.nanvl("reach", F.lit(math.inf)), F.lit(math.inf)).alias("reach"))
        few = asked.count() <= SENT_KEYS  # then the vectors of the others need not be shuffled
        asked = F.broadcast(asked) if few else asked
        rows, reach = self.rows, asked.withColumnRenamed("id", "rep")
        if self.copies:
            # The copies of a vector have one list; the smallest of their distances is true for all.
            rows = self.rows.join(asked, "id")
            reach = rows.groupBy("h", "x").agg(F.min("reach").alias("reach")).join(self.distinct, ["h", "x"]).select("rep", "reach")
        askers = self.cells.vectors.select("rep", "x", "cell", "fine", F.lit(-1).alias("block"))  # own block not met yet
        reach = reach.select("rep", (F.col("reach") * (1 + REACH_ROUNDING)).alias("reach"))
        askers = askers.join(F.broadcast(reach) if few else reach, "rep")
        return self.told(keep_best(visit(self.cells, askers, self.k), self.k + 1), rows)


def collapsed(rows: DataFrame, most: int) -> DataFrame:
    """``(h, x, ids)`` of the distinct vectors in ``rows``, each with its first ``most`` ids.

    One pass counts the hashes; vectors whose hash occurs once are not shuffled, unless the hashes that
    occur more often are too many to broadcast.
    """
    repeated = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    n = repeated.count()
    copies = rows if n > SENT_KEYS else rows.join(F.broadcast(repeated), "h", "left_semi")
    first_ids = Window.partitionBy("h", "x").orderBy("id")
    grouped = (
        copies.withColumn("_place", F.row_number().over(first_ids))
        .where(F.col("_place") <= most)
        .groupBy("h", "x")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    if n > SENT_KEYS:
        return grouped
    single = rows.join(F.broadcast(repeated), "h", "left_anti") if n else rows
    single = single.select("h", "x", F.filter(F.array("id"), lambda v: v.isNotNull()).alias("ids"))
    return single.unionByName(grouped) if n else single


def share_lists(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Give each copy of a vector the list of that vector.

    The lists of vectors with very many copies (over 1/1000 of all rows, so fewer
    than 1000 vectors) are broadcast; the rest is an ordinary join.
    """
    floor = max(rows.count() // HOT_SHARE, HOT_FLOOR)
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > floor)
    hot = [r.h for r in counts.select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    told = rows.where(~is_hot).join(shared.where(~is_hot), ["h", "x"])
    if hot:
        told = told.unionByName(rows.where(is_hot).join(F.broadcast(shared.where(is_hot)), ["h", "x"]))
    return told.select(F.col("id").alias("row_id"), "near")


def assign_cells(distinct: DataFrame, n: int, block_rows: int, max_pivots: int = MAX_PIVOTS) -> "Cells":
    """Give each vector the cell of its nearest pivot and a block within that cell."""
    blocks = max(math.ceil(n / block_rows), 1)
    wanted = min(blocks, max_pivots)
    order = hash_order("pivot", F.col("rep"))
    chosen = distinct.orderBy(order).limit(wanted).select("x").collect()
    pivots = np.array([r.x for r in chosen], dtype=np.float64)
    if len(pivots) <= 1:
        located = distinct.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)})
    else:
        sent = distinct.sparkSession.sparkContext.broadcast(pivots)

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, len(sent.value)):
                x = matrix(batch["x"])
                cell = nearest_of(x, sent.value)
                radius = np.sqrt(((x - sent.value[cell]) ** 2).sum(axis=1))
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("radius", pa.array(radius))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
        located = distinct.mapInArrow(locate, f"{fields}, cell int, radius double")
        located = materialize(located)
    return Cells(located, pivots, block_rows, two_levels=blocks > max(wanted, 1) > 1)


class Cells:
    """Vectors with the numbers of their cell, its part, the block in it and the shelf the block lies on,
    and the geometry of the cells."""

    def __init__(self, located: DataFrame, pivots: np.ndarray, block_rows: int, two_levels: bool = False):
        stats = located.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
        )
        table = {r.cell: (r.n, r.low, r.high) for r in stats.collect()}
        self.pivots = pivots
        self.count = max(len(pivots), 1)
        self.rows = np.array([table.get(c, (0, 0.0, 0.0))[0] for c in range(self.count)])
        self.low = np.array([table.get(c, (0, 0.0, 0.0))[1] for c in range(self.count)])
        self.high = np.array([table.get(c, (0, 0.0, 0.0))[2] for c in range(self.count)])
        self.blocks = np.maximum(np.ceil(self.rows / block_rows), 1).astype(int)
        dealt = F.xxhash64(F.lit(7), "rep")
        if two_levels:
            fine = self.cut_again(located, block_rows)
            parts = fine.groupBy("cell", "fine").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
            parts = materialize(parts)
            for row in parts.groupBy("cell").agg(F.sum("blocks").alias("n")).collect():
                self.blocks[row.cell] = row.n
            joined = fine.join(parts, ["cell", "fine"])
            vectors = joined.withColumn("block", F.pmod(dealt, F.col("blocks")).cast("int")).drop("blocks")
        else:
            vectors = located.withColumns({"fine": F.lit(0), "block": F.pmod(dealt, per_cell(self.blocks)).cast("int")})
        self.groups = int(self.blocks.sum())
        self.shelf_rows = shelf_rows(int(self.rows.sum()), pivots.shape[-1], located.sparkSession.sparkContext.defaultParallelism)
        self.first, self.shelves = shelve(self.rows, self.pivots, self.shelf_rows)
        turn = F.pmod(F.xxhash64(F.lit(17), "fine", "block"), per_cell(self.shelves)).cast("int")
        vectors = vectors.withColumn("shelf", per_cell(self.first) + turn)
        self.vectors = materialize(vectors) if two_levels else vectors
        self.id_type = located.schema["rep"].dataType.simpleString()
        self.found = f"rep {self.id_type}, id {self.id_type}, d double"  # columns of candidates

    def salted(self, df: DataFrame, per_group: int) -> DataFrame:
        """``df`` with a ``salt`` that splits the rows of a cell into groups of about ``per_group``."""
        salts = per_cell(np.maximum(np.ceil(self.rows / per_group), 1))
        return df.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "rep"), salts).cast("int"))

    def for_salts(self, df: DataFrame, per_group: int) -> DataFrame:
        """``df`` repeated for every salt of its cell."""
        salts = per_cell(np.maximum(np.ceil(self.rows / per_group), 1))
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def cut_again(self, located: DataFrame, block_rows: int) -> DataFrame:
        """The vectors with their part of the cell.

        About one vector for every ``block_rows`` of a cell, drawn by hash, is the pivot of a part; a part
        that is still larger is dealt into blocks by hash.
        """
        shares = F.element_at(F.array(*[F.lit(1.0 / block_rows if n > block_rows else 0.0) for n in self.rows.tolist()]), F.col("cell") + 1)
        drawn = located.where(hash_unit(hash_order("part", F.col("rep"))) < shares)
        size, schema = max(16 * block_rows, 4 * BLOCK_ROWS), located.schema
        pivots = self.for_salts(drawn.select("cell", "rep", "x"), size)
        names = schema.names

        def locate(rows: pa.Table, centers: pa.Table) -> pa.Table:
            count = len(rows)
            fine = np.zeros(count, dtype=np.int32)
            if count and len(centers):
                y = matrix(centers.sort_by("rep")["x"])
                x = matrix(rows["x"])
                fine = np.concatenate([squared_distances(x[i : i + 512], y).argmin(axis=1) for i in range(0, count, 512)]).astype(np.int32)
            return rows.select(names).append_column("fine", pa.array(fine))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        groups = self.salted(located, size).groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt"))
        return materialize(groups.applyInArrow(locate, f"{fields}, fine int"))

    def shape(self) -> tuple[np.ndarray, ...]:
        """Pivots, rows and radius range per cell: at most one row of each per pivot."""
        return self.pivots, self.rows, self.low, self.high


def per_cell(values: np.ndarray) -> Column:
    """A whole number for each cell, as a column of rows with a ``cell``."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def shelf_rows(n: int, width: int, cores: int) -> int:
    """Rows of a shelf: a share of the table, so that the trips of a row do not grow with it, as far as a task holds them."""
    shelves = max(SHELVES, math.ceil(math.sqrt(4 * cores)))
    return max(1, min(max(math.ceil(n / shelves), BLOCK_ROWS), SHELF_ROWS, SHELF_BYTES // (8 * max(width, 1))))


def shelve(rows: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf and number of shelves of each cell.

    Cells that lie close together share a shelf; one above ``most`` rows has several for itself.
    """
    first, shelves = np.zeros(len(rows), dtype=int), np.ones(len(rows), dtype=int)
    order = np.concatenate(leaves_of(pivots, 1)) if len(rows) > 1 else np.arange(len(rows))
    shelf, held = 0, 0
    for c in order.tolist():
        if held and held + rows[c] > most:
            shelf, held = shelf + 1, 0
        first[c], shelves[c] = shelf, max(1, math.ceil(rows[c] / most))
        held += rows[c]
        if shelves[c] > 1:
            shelf, held = shelf + shelves[c], 0
    return first, shelves


def search(cells: Cells, k: int, block_rows: int) -> DataFrame:
    """Meet the own block, then every block that may still hold a nearer row."""
    vectors, found = cells.vectors, cells.found

    def own_block(group: pa.Table) -> pa.Table:
        x = matrix(group["x"])
        row, place, d = Hosts(group).nearest(x, np.full(len(x), math.inf), k + 1)
        return candidates(group, group, row, place, d)

    groups = cells.groups
    spread = vectors.repartition(tasks_for(vectors, groups), "cell", "fine", "block")
    home = spread.groupBy("cell", "fine", "block").applyInArrow(own_block, found)
    if groups <= 1:
        return keep_best(home, k + 1)
    home = materialize(home)
    reach = home.groupBy("rep").agg(F.count("*").alias("n"), F.max("d").alias("reach"))
    reach = reach.select("rep", F.when(F.col("n") > k, F.col("reach")).otherwise(F.lit(math.inf)).alias("reach"))
    askers = vectors.select("rep", "x", "cell", "fine", "block").join(reach, "rep")
    return keep_best(home.unionByName(visit(cells, askers, k)), k + 1)


def visit(cells: Cells, askers: DataFrame, k: int) -> DataFrame:
    """Candidates ``(rep, id, d)`` within the reach of each asker, from all blocks but its own."""
    vectors, most = cells.vectors, cells.shelf_rows
    askers = materialize(with_trips(askers.repartition(tasks_for(askers, cells.groups), "rep"), cells))
    trips = askers.withColumn("shelf", F.explode("shelves")).drop("shelves")
    # A shelf with many askers is copied so that each task meets a bounded number of them.
    visits = {r.shelf: r.n for r in trips.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    visited = [(shelf, math.ceil(n / most)) for shelf, n in sorted(visits.items())]
    table = vectors.sparkSession.createDataFrame(visited, "shelf int, copies int")  # a row for each shelf
    part = F.pmod(F.xxhash64(F.lit(11), "rep"), F.col("copies")).cast("int").alias("part")
    away = trips.join(F.broadcast(table), "shelf").select("shelf", part, "rep", "x", "reach", "cell", "fine", "block")
    hosts = vectors.join(F.broadcast(table), "shelf").select(
        "shelf", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), "x", "ids", "cell", "fine", "block"
    )

    def other_blocks(guests: pa.Table, residents: pa.Table) -> pa.Table:
        if not len(guests) or not len(residents):
            nothing = np.empty(0, dtype=np.int64)
            return candidates(guests, residents, nothing, nothing, np.empty(0))
        met = Hosts(residents, block_numbers(residents))
        row, place, d = met.nearest(matrix(guests["x"]), guests["reach"].to_numpy(), k + 1, block_numbers(guests))
        return candidates(guests, residents, row, place, d)

    keys, groups = ["shelf", "part"], max(1, sum(copies for _, copies in visited))
    tasks = max(groups, min(4 * groups, 512))  # where groups are few, hashing would put several into one task
    away, hosts = away.repartition(tasks, *keys), hosts.repartition(tasks, *keys)
    return away.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInArrow(other_blocks, cells.found)


def with_trips(askers: DataFrame, cells: Cells) -> DataFrame:
    """The askers with the ``shelves`` they have to visit; a cell that is one block is not visited from that block."""
    sent = askers.sparkSession.sparkContext.broadcast((*cells.shape(), cells.first, cells.shelves, cells.blocks))
    kept = ["rep", "x", "reach", "cell", "fine", "block"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *shape, first, shelves, blocks = sent.value
        geometry = Geometry(*shape) if len(first) > 1 else None  # the radii of a single cell are not taken
        several = int((first + shelves).max())
        for batch in pieces(batches, len(first)):
            near = np.ones((len(batch), 1), dtype=bool) if geometry is None else geometry.may_hold_nearer(batch)
            home, block = batch["cell"].to_numpy(), batch["block"].to_numpy()
            alone = np.flatnonzero((block >= 0) & (blocks[home] == 1))
            near[alone, home[alone]] = False
            row, cell = np.nonzero(near)
            times = shelves[cell]
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            trips = np.unique(np.repeat(row, times) * several + np.repeat(first[cell], times) + turn)
            ends = np.concatenate([[0], np.cumsum(np.bincount(trips // several, minlength=len(batch)))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(trips % several, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), lists], [*kept, "shelves"])

    fields = f"rep {cells.id_type}, x array<double>, reach double, cell int, fine int, block int, shelves array<int>"
    return askers.select(*kept).mapInArrow(choose, fields).where(F.size("shelves") > 0)


def block_numbers(rows: pa.Table) -> np.ndarray:
    """One number for cell, part and block; -1 where a row has not met its block."""
    cell, fine, block = (rows[c].to_numpy().astype(np.int64) for c in ("cell", "fine", "block"))
    return np.where(block < 0, -1, (cell << 52) | (fine << 26) | block)


def tasks_for(df: DataFrame, groups: int) -> int:
    """Tasks for groups that are small in bytes but heavy in work.

    Adaptive execution would merge them by their bytes into few tasks, so the
    number is set: a few per core or a task per ``GROUPS_PER_TASK``, never more than
    there are groups.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    several = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS_PER_TASK)
    return max(1, min(groups, several))


def keep_best(met: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each vector as one sorted list."""
    order = Window.partitionBy("rep").orderBy("d", "id")
    ranked = met.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return ranked.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))


class Geometry:
    """What tasks need to know of the cells; its size is bounded by the number of pivots."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.rows, self.low, self.high = pivots, rows, low, high
        center = self.pivots.mean(axis=0)
        widest = (np.sqrt(((self.pivots - center) ** 2).sum(axis=1)) + self.high).max()
        # Far above the rounding error of a squared distance by matrix product.
        self.error = ROUNDING * (1 + self.pivots.shape[1]) * widest**2
        self.between = np.sqrt(np.maximum(squared_distances(self.pivots, self.pivots), 0.0)) + np.sqrt(self.error)

    def may_hold_nearer(self, askers: pa.RecordBatch) -> np.ndarray:
        """Which cells could hold a row within reach of each vector: (rows, cells) flags.

        Rounding only ever adds cells: every bound is lowered by the error it may carry.
        """
        return self.reached(matrix(askers["x"]), askers["reach"].to_numpy(), askers["cell"].to_numpy())

    def reached(self, x: np.ndarray, reach: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
        """The same for vectors of which the cell (any cell, best the nearest) need not be known."""
        square = squared_distances(x, self.pivots)
        cell = square.argmin(axis=1) if cell is None else cell
        home, limit = square[np.arange(len(x)), cell], reach * (1 + ROUNDING)
        # Most cells are too far by their outer radius alone; only the others are looked at closely.
        row, col = np.nonzero((square <= (limit[:, None] + self.high) ** 2 * (1 + CLOSE) + 2 * self.error) & (self.rows > 0))
        square = square[row, col]
        nearest = np.sqrt(np.maximum(square - self.error, 0.0)) - self.high[col]
        np.maximum(nearest, self.low[col] - np.sqrt(square + self.error), out=nearest)
        # Rows of a cell lie on their pivot's side of the plane halfway to any other pivot.
        between = self.between[cell[row], col]  # 0 only from a pivot to itself, where the plane tells nothing
        beyond = np.divide(square - home[row] - 4 * self.error, 2 * between, out=np.full(len(row), -np.inf), where=between > 0)
        np.maximum(nearest, beyond, out=nearest)
        out = np.zeros((len(x), len(self.rows)), dtype=bool)
        out[row, col] = nearest <= limit[row]
        return out


def nearest_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place in ``y`` of the vector nearest to each of ``x``; the square of ``x`` itself changes no order."""
    center = y.mean(axis=0)
    y = y - center
    score = (x - center) @ (-2 * y.T)
    score += (y**2).sum(axis=1)
    return score.argmin(axis=1)


def pieces(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """Batches cut small enough for a (rows, pivots) matrix that stays in a core's cache."""
    rows = min(512, max(64, PIECE_CELLS // max(pivots, 1)))
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    column = whole(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by matrix product, around the mean of ``y`` to keep rounding small."""
    center = y.mean(axis=0)
    x, y = x - center, y - center
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0)


def measured(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs from their differences."""
    out = np.empty(len(row))
    for start in range(0, len(row), 65536):
        part = slice(start, start + 65536)
        out[part] = np.sqrt(((x[row[part]] - y[col[part]]) ** 2).sum(axis=1))
    return out


def leaves_of(y: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the rows in leaves of at most ``most``, halved along their widest side; neighbours in the list lie close."""
    leaves, open_parts = [], [np.arange(len(y))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= most:
            leaves.append(part)
            continue
        sides = y[part]
        side = sides[:, (sides.max(axis=0) - sides.min(axis=0)).argmax()]
        half = np.argpartition(side, len(part) // 2)
        open_parts += [part[half[len(part) // 2 :]], part[half[: len(part) // 2]]]
    return leaves


class Hosts:
    """Rows that others meet in one task, in leaves with their bounding boxes; each row stands for all its ids."""

    def __init__(self, rows: pa.Table, blocks: np.ndarray | None = None):
        ids = whole(rows["ids"])
        y, lengths = matrix(rows["x"]), pc.list_value_length(ids).to_numpy()
        if not np.isfinite(y).all():
            raise ValueError("vectors hold missing or infinite values")
        # Equal distances rank by id, whatever the type of the id.
        self.id_order = pc.rank(ids.flatten(), tiebreaker="dense").to_numpy().astype(np.int64)
        first = np.cumsum(lengths) - lengths
        leaves = leaves_of(y, LEAF_ROWS)
        self.low = np.array([y[at].min(axis=0) for at in leaves])
        self.high = np.array([y[at].max(axis=0) for at in leaves])
        self.leaves = [(y[at], lengths[at], first[at], None if blocks is None else blocks[at]) for at in leaves]

    def nearest(
        self, x: np.ndarray, reach: np.ndarray, k: int, blocks: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest ids for each row of ``x``, within its reach and not of its own block.

        Returns row of ``x``, place in the flattened ids, and distance. A leaf is met by the rows whose
        k-th distance so far reaches its box, the leaf closest to a row first.
        """
        out = []
        for start in range(0, len(x), 4096):
            part = slice(start, start + 4096)
            best = Best(x[part], reach[part], k, None if blocks is None else blocks[part])
            away = self.box_distances(best.x)
            closest = away.argmin(axis=1)
            for leaf in np.unique(closest).tolist():
                self.meet(leaf, best, np.flatnonzero(closest == leaf))
            away[np.arange(len(away)), closest] = math.nan  # not below any reach
            for leaf in range(len(self.leaves)):
                self.meet(leaf, best, np.flatnonzero(away[:, leaf] <= best.reach * (1 + ROUNDING)))
            row, slot = np.nonzero(best.place >= 0)
            out.append((start + row, best.place[row, slot], best.d[row, slot]))
        return tuple(np.concatenate(parts) for parts in zip(*out))

    def box_distances(self, x: np.ndarray) -> np.ndarray:
        """How far each row is from each box at least."""
        square = np.zeros((len(x), len(self.leaves)))
        for i in range(x.shape[1]):
            v = x[:, i : i + 1]
            square += np.maximum(np.maximum(self.low[:, i] - v, v - self.high[:, i]), 0.0) ** 2
        return np.sqrt(square) * (1 - ROUNDING)

    def meet(self, leaf: int, best: "Best", rows: np.ndarray) -> None:
        """Matrix products shortlist candidates within their rounding error; only the shortlist is measured exactly."""
        y, lengths, first, blocks = self.leaves[leaf]
        k = best.k
        for start in range(0, len(rows), 512):
            asked = rows[start : start + 512]
            x, reach = best.x[asked], best.reach[asked]
            rough, error = squared_distances(x, y), rounding_error(x, y)
            if blocks is not None and best.blocks is not None:
                own = np.flatnonzero(np.isin(best.blocks[asked], blocks))
                rough[own] = np.where(best.blocks[asked[own]][:, None] == blocks, math.inf, rough[own])
            cut = reach**2 * (1 + ROUNDING) + 2 * error
            near = (rough <= cut[:, None]) & (rough < math.inf)
            if len(y) > k and np.count_nonzero(near) > 4 * k * len(asked):
                cut = np.minimum(cut, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error)
                near &= rough <= cut[:, None]
            row, col = np.nonzero(near)
            if not len(row):
                continue
            d = measured(x, y, row, col)
            # The k-th distance decides before ids are laid out, ties included.
            order = np.lexsort((d, row))
            row, col, d = row[order], col[order], d[order]
            count = np.bincount(row, minlength=len(asked))
            begin = np.cumsum(count) - count
            keep = d <= np.minimum(d[begin + np.minimum(count, k) - 1], reach)[row]
            row, col, d = row[keep], col[keep], d[keep]
            times = lengths[col]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            best.add(asked[np.repeat(row, times)], np.repeat(first[col], times) + within, np.repeat(d, times), self.id_order)


class Best:
    """The k best ids so far of each row, and how far a better one may be."""

    def __init__(self, x: np.ndarray, reach: np.ndarray, k: int, blocks: np.ndarray | None):
        self.x, self.reach, self.k, self.blocks = x, reach.copy(), k, blocks
        self.d, self.place = np.full((len(x), k), math.inf), np.full((len(x), k), -1, dtype=np.int64)

    def add(self, row: np.ndarray, place: np.ndarray, d: np.ndarray, id_order: np.ndarray) -> None:
        if not len(row):
            return
        changed = np.unique(row)
        held, slot = np.nonzero(self.place[changed] >= 0)
        row = np.concatenate([row, changed[held]])
        place = np.concatenate([place, self.place[changed[held], slot]])
        d = np.concatenate([d, self.d[changed[held], slot]])
        order = np.lexsort((id_order[place], d, row))
        row, place, d = row[order], place[order], d[order]
        count = np.bincount(row, minlength=len(self.x))
        slot = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        keep = slot < self.k
        self.d[row[keep], slot[keep]], self.place[row[keep], slot[keep]] = d[keep], place[keep]
        self.reach[changed] = np.minimum(self.reach[changed], self.d[changed, self.k - 1])


def rounding_error(x: np.ndarray, y: np.ndarray) -> float:
    """Bound of the error of a squared distance by matrix product."""
    center = y.mean(axis=0)
    widest = max(((x - center) ** 2).sum(axis=1).max(), ((y - center) ** 2).sum(axis=1).max())
    return ROUNDING * (1 + x.shape[1]) * widest


def candidates(askers: pa.Table, hosts: pa.Table, row: np.ndarray, place: np.ndarray, d: np.ndarray) -> pa.Table:
    """Candidate rows ``(rep, id, d)`` out of positions in the askers and in the hosts' ids."""
    ids = whole(hosts["ids"]).flatten()
    return pa.table({"rep": askers["rep"].take(pa.array(row)), "id": ids.take(pa.array(place)), "d": pa.array(d)})


def tomek_links(
    points: DataFrame,
    row_id: str = "row_id",
    vector: str = "x",
    target: str = "target",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of opposite class that are each other's nearest row: ``(low_id, high_id, distance)``."""
    return mutual(knn_join(points, 1, row_id, vector, block_rows), points, row_id, target)


def tomek_links_within(
    points: DataFrame,
    reach: DataFrame,
    row_id: str = "row_id",
    vector: str = "x",
    target: str = "target",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The links of :func:`tomek_links` where ``reach`` holds the rows of all classes but one:
    ``(row_id, reach)``, a distance within which each of them has another row.

    One end of every link is in ``reach``. Those rows search within their distance; rows of the class
    left out search only if they came out as the nearest of one of them, no farther than that.
    """
    layout = Layout(points, 1, row_id, vector, block_rows)
    if layout.cells.groups <= 1:
        # All rows meet in one block; no distance could spare a trip.
        return mutual(ranked(layout.told(search(layout.cells, 1, block_rows), layout.rows), 1), points, row_id, target)
    first = materialize(ranked(layout.nearest_within(reach), 1))
    back = first.groupBy(F.col("neighbor_id").alias("row_id")).agg(F.min("distance").alias("reach"))
    back = back.join(reach.select("row_id"), "row_id", "left_anti")
    return mutual(first.unionByName(ranked(layout.nearest_within(materialize(back)), 1)), points, row_id, target)


def mutual(nearest: DataFrame, points: DataFrame, row_id: str, target: str) -> DataFrame:
    """Pairs of opposite class that named each other.

    They meet by grouping on the unordered pair, so each group has at most two rows.
    """
    own = points.select(F.col(row_id).alias("row_id"), F.col(target).alias("y"))
    pair = nearest.join(own, "row_id").select(
        F.least("row_id", "neighbor_id").alias("low_id"),
        F.greatest("row_id", "neighbor_id").alias("high_id"),
        "y",
        "distance",
    )
    return (
        pair.groupBy("low_id", "high_id")
        .agg(
            F.count("*").alias("n"), F.min("y").alias("y_low"), F.max("y").alias("y_high"), F.min("distance").alias("distance")
        )
        .where("n = 2 and y_low <> y_high")
        .select("low_id", "high_id", "distance")
    )
