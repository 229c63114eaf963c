"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is posted under each (coordinate, value) of its signature. Two documents that share
at least ``required`` of the coordinates must meet under one of the ``coordinates - required + 1``
rarest of each (prefix filter); values that occur once cannot match and fill prefixes first, so most
documents are not posted at all. Pairs that meet have the collisions of their signatures counted (the
frequent postings behind the prefix are skipped and probed by position instead), and pairs above the
match threshold are confirmed on their full shingle sets.

Groups of copies never become all their pairs: equal sets count as one, posting lists are first
linked through leaders, and only documents that are not yet connected are compared further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import stored
from ballast.llm.components import connected_components

COORDINATES = 64
MISS = 1e-6  # accepted chance that a pair at the threshold falls short of the match threshold
SHORT_LIST = 8  # members of a posting list that are paired at once
BLOCK_ROWS, CELLS_ROWS = 512, 1024  # rows of a block of a long list, and of a group of cells
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def required_matches(coordinates: int, similarity: float) -> int:
    """The largest match threshold that a pair at ``similarity`` misses with a chance below ``MISS``."""
    below = 0.0
    for matches in range(coordinates + 1):
        below += comb(coordinates, matches) * similarity**matches * (1 - similarity) ** (coordinates - matches)
        if below > MISS:
            return max(matches, 1)
    return coordinates


@dataclass(frozen=True)
class Settings:
    """Words per shingle, and the similarity as a fraction so that the bound is exact in integers."""

    shingle_words: int = 5
    similarity: tuple[int, int] = (80, 100)
    coordinates: int = COORDINATES

    @property
    def required(self) -> int:
        return required_matches(self.coordinates, self.similarity[0] / self.similarity[1])

    @property
    def prefix(self) -> int:
        return self.coordinates - self.required + 1


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than a shingle count as one.

    Words are the runs without ASCII white space, A-Z lower-cased.
    """
    parts = (text or "").encode("utf-8", "ignore").lower().split()
    if not parts:
        return np.array([], np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64)
    rolled = np.zeros(len(parts) - words + 1, np.uint64)
    for i in range(words):
        rolled = mix(rolled + hashes[i : len(parts) - words + 1 + i] * MULTIPLIERS[i % 3])
    return np.unique(rolled)


def seeds(coordinates: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"coordinate", seed=i + 1) for i in range(coordinates)], np.uint64)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Minima of ``coordinates`` hash functions over each non-empty set, 32 bits each."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), coordinates), np.int32)
    for k, seed in enumerate(seeds(coordinates)):
        hashed = (flat ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0x9FB21C651E98DF25)
        out[:, k] = np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32), starts).view(np.int32)
    return out


def sign(documents: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """``(id, n_shingles, set_key, signature)`` of each row; the last two NULL for empty sets."""
    kind = documents.schema[key].dataType.simpleString()
    words, coordinates = settings.shingle_words, settings.coordinates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # keeps the hashed values in the cache
                part = batch.slice(at, 128)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full, coordinates)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(signed) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    ],
                    names=["id", "n_shingles", "set_key", "signature"],
                )

    wanted = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return wanted.mapInArrow(run, f"id {kind}, n_shingles bigint, set_key binary, signature array<int>")


def set_table(documents: DataFrame, classes: DataFrame, lists: DataFrame, settings: Settings, key: str, text: str, repeats: bool) -> DataFrame:
    """``(id, signature, shingles)`` of the documents that are in some list; shingles are packed 64-bit hashes."""
    texts = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(lists.select("id").distinct(), "id", "left_semi")
    if repeats:
        texts = texts.distinct()
    kind, words = texts.schema["id"].dataType.simpleString(), settings.shingle_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "shingles"])

    sets = texts.mapInArrow(run, f"id {kind}, shingles binary")
    return sets.join(classes.select(F.col("rep").alias("id"), "signature"), "id").select("id", "signature", "shingles")


def similar(one: np.ndarray, other: np.ndarray, top: int, bottom: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared > 0 and bottom * shared >= top * (len(one) + len(other) - shared)


def confirm(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    top, bottom = settings.similarity
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), top, bottom)
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def link_cell(ids: list, component: list, side: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], settings: Settings) -> list[tuple]:
    """Links that join the components of one cell as far as similar sets reach: at most one fewer than components.

    ``side`` names the block of each row; a cell of one block compares its rows with each other.
    """
    names = {c: n for n, c in enumerate(dict.fromkeys(component))}
    own = np.array([names[c] for c in component])
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    top, bottom = settings.similarity
    shingles, spot = np.unique(np.concatenate([sets[r] for r in right]), return_inverse=True)
    size = np.array([len(sets[r]) for r in right])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    links = []
    for row in left:
        if not (own[right] != own[row]).any():
            continue
        agree = (signature[right] == signature[row]).sum(1) >= settings.required
        if not (agree & (own[right] != own[row])).any():
            continue
        mark = np.zeros(len(shingles), np.int64)
        at = np.searchsorted(shingles, sets[row])
        inside = at < len(shingles)
        at, values = at[inside], sets[row][inside]
        mark[at[shingles[at] == values]] = 1
        shared = np.add.reduceat(mark[spot], starts)
        good = agree & (shared > 0) & (bottom * shared >= top * (size + len(sets[row]) - shared))
        for k in np.flatnonzero(good):
            other = right[k]
            if own[other] != own[row]:
                links.append((ids[row], ids[other]))
                own[own == own[other]] = own[row]
    return links


def link_rest(apart: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links between members of one list that are still apart, without laying out their pairs.

    A list is dealt into blocks, each two blocks are a cell, and a cell returns only what connects
    components. ``apart`` has ``posting``, ``id`` and ``component``.
    """
    blocks = apart.groupBy("posting").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", "posting"), "blocks").cast("int")
    dealt = by_posting(apart, blocks).withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = stored(dealt.select("id", "component", "i", F.xxhash64("posting", F.least("i", "j"), F.greatest("i", "j")).alias("cell")), "cells")
    groups = max(1, cells.count() // CELLS_ROWS)
    work = cells.join(sets, "id").withColumn("group", F.pmod("cell", F.lit(groups)))
    kind = apart.schema["id"].dataType.simpleString()

    def measure(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("cell").to_numpy(), kind="stable")
        cell = table.column("cell").to_numpy()[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        found = []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            part = table.take(pa.array(order[start:stop]))
            sides = part.column("i").to_numpy()
            found += link_cell(
                part.column("id").to_pylist(), part.column("component").to_pylist(), sides, np.array(part.column("signature").to_pylist(), np.int32),
                [np.frombuffer(b, np.uint64) for b in part.column("shingles").to_pylist()], settings,
            )
        return pa.table({"a": pa.array([a for a, _ in found], table.schema.field("id").type), "b": pa.array([b for _, b in found], table.schema.field("id").type)})

    return work.groupBy("group").applyInArrow(measure, f"a {kind}, b {kind}")


def near_duplicates(documents: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per input row.

    ``component_id`` is the smallest key reachable over links of at least the given similarity, the
    row's own included; ``kept`` marks the row whose key that is. NULL and empty texts have no
    shingles and no links. Rows without a key are linked with nothing and kept. Rows that repeat a
    key are one document with several texts: whatever one of them reaches, all reach.
    """
    settings = settings or Settings()
    spark = documents.sparkSession
    signed = stored(sign(documents, settings, key, text), "signatures")
    posted = signed.where(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    # One representative per distinct set; all its copies hang on it.
    classes = stored(posted.groupBy("set_key").agg(F.min("id").alias("rep"), F.min_by("signature", "id").alias("signature")), "classes")
    repeated = posted.groupBy("id").agg(F.count("*").alias("n"), F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("n > 1")
    repeated = stored(repeated, "repeated")
    several = posted.join(repeated.where("x != y").select("id"), "id", "left_semi").select("id", "set_key").distinct()
    bridges = several.join(classes.select("set_key", "rep"), "set_key").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    lists = rare_postings(classes, settings)
    sets = stored(set_table(documents, classes, lists, settings, key, text, not repeated.isEmpty()), "sets")
    roots = link_lists(lists, sets, classes, bridges, settings)
    whole = classes.select("set_key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    whole = stored(whole, "components")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.select("id", "n_shingles", "set_key").join(whole, "set_key", "left").select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def rare_postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """``(id, posting, n)``: each representative under the rarest values of its signature, ``n`` to a list."""
    ids = classes.select(F.col("rep").alias("id"), "signature")
    where = F.posexplode("signature").alias("coordinate", "value")
    postings = ids.select("id", where).select("id", F.expr("shiftleft(cast(coordinate as bigint), 32) | (cast(value as bigint) & 4294967295)").alias("posting"))
    frequent = postings.groupBy("posting").count().where("count > 1")
    shared = postings.join(frequent, "posting").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("count").alias("n"), "posting"))).alias("found"))
    # Values that occur once come first in a prefix and match nothing.
    single = settings.coordinates - F.size("found")
    prefixes = shared.where(single < settings.prefix).select("id", F.explode(F.slice("found", 1, F.lit(settings.prefix) - single)).alias("p"))
    return stored(prefixes.select("id", "p.posting", "p.n"), "postings")


def link_lists(lists: DataFrame, sets: DataFrame, classes: DataFrame, bridges: DataFrame, settings: Settings) -> DataFrame:
    """Components ``(node, root)`` over all links between members of one list.

    Short lists give all their pairs at once, long ones the pairs with a leader, another document in
    each list. Members of long lists that are then still apart are compared in cells.
    """
    ids = classes.select(F.col("rep").alias("id"), "signature")
    short = lists.where(F.col("n") <= SHORT_LIST)
    left, right = short.select("posting", F.col("id").alias("a")), short.select("posting", F.col("id").alias("b"))
    long = lists.where(F.col("n") > SHORT_LIST).select("posting", "id")
    pairs = left.join(right, "posting").where(F.col("a") < F.col("b")).select("a", "b").unionByName(led(long)).distinct()
    counted = stored(enough_collisions(pairs, ids, settings), "pairs")
    links = bridges.unionByName(stored(confirm(counted, sets, settings), "links"))
    roots = connected_components(links)
    placed = long.join(roots, F.col("id") == F.col("node"), "left").select("posting", "id", F.coalesce("root", "id").alias("component"))
    mixed = placed.groupBy("posting").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high"))
    apart = stored(by_posting(placed, mixed.select("posting"), "left_semi"), "apart")
    if apart.isEmpty():
        return roots
    more = stored(link_rest(apart, sets, settings), "links")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(stars.unionByName(more))


def by_posting(members: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Join members to one row per list.

    ``lists`` was grouped by posting. The hash beside the key makes both sides exchange anew, so
    that adaptive execution can split a list that holds many members.
    """
    spread = F.xxhash64("posting").alias("spread")
    return members.select("*", spread).join(lists.select("*", spread), ["spread", "posting"], how).drop("spread")


def led(lists: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of each member with the leader of its list."""
    leader = lists.groupBy("posting").agg(F.min_by("id", F.xxhash64("id", "posting")).alias("leader"))
    met = by_posting(lists, leader).where(F.col("id") != F.col("leader"))
    return met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))


def enough_collisions(pairs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose signatures agree in at least the required number of coordinates."""
    one = ids.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    two = ids.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(one, "a").join(two, "b").where(agree >= settings.required).select("a", "b")
