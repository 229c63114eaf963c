"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (letters and digits lower-cased, runs of anything else one
blank). If an item of m characters occurs in a text with at most e edits, the two share at least
m + 1 - q - q * e q-grams whose diagonals (position in the text minus position in the item) lie
within a band of width e. Shared q-grams are counted in overlapping diagonal bands; bands that meet
the bound are verified by a banded alignment, so that nothing within the edit budget is missed and
nothing beyond it reported. Items longer than a window are also indexed as overlapping windows, so
that a part of an item, or an item with replaced words, is found as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.columns import append_columns, fresh

Q = 12
EDIT_RATE = 0.05
WINDOW = 200  # normalised characters, 30 to 40 words
WINDOW_STEP = 50
WINDOW_RATE = 0.075  # three replaced words of about five characters in a window
PART_CHARS = 20_000_000  # characters of benchmark text in one index
BATCH_CHARS = 1_000_000  # characters of a text hashed at a time
BATCH_POSTINGS = 500_000  # shared q-grams counted at a time
SHIFT, LOW_BITS = 1 << 40, 42  # a band is its item and its first diagonal, shifted to be positive
TABLE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = 32


def fold_table() -> np.ndarray:
    """Code point -> lower-cased code point, or a blank for what is neither letter nor digit."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalnum() else BLANK for c in range(0x10000)], np.uint32)


def normalise(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the position of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = np.where(raw < 0x10000, table[np.minimum(raw, 0xFFFF)], raw)
    blank = folded == BLANK
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    where = np.flatnonzero(keep)
    return folded[where], where


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, by doubling."""
    if len(codes) < q:
        return np.array([], np.uint64)
    power, size, hashes = BASE, 1, codes.astype(np.uint64) + np.uint64(1)
    done, done_size = None, 0
    left = q
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, done_size = hashes, size
                else:  # the part so far, followed by this block
                    n = len(codes) - done_size - size + 1
                    done = done[:n] * power + hashes[done_size : done_size + n]
                    done_size += size
            left >>= 1
            if left:
                n = len(codes) - 2 * size + 1
                hashes = hashes[:n] * power + hashes[size : size + n]
                power, size = power * power, 2 * size
    return done


def slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Index:
    """All q-grams of the items and then of their windows, sorted by hash, with a bit table in front."""

    ids: list
    items: list[np.ndarray]
    q: int
    rate: float

    def __post_init__(self) -> None:
        whole = len(self.items)
        cuts = [(i, start) for i, codes in enumerate(self.items) for start in window_starts(len(codes))]
        self.owner = [*range(whole), *[i for i, _ in cuts]]
        self.items = [*self.items, *[self.items[i][start : start + WINDOW] for i, start in cuts]]
        hashes = [gram_hashes(codes, self.q) for codes in self.items]
        flat = np.concatenate([*hashes, np.array([], np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        at = np.concatenate([*[np.arange(len(h)) for h in hashes], np.array([], np.int64)])
        order = np.argsort(flat, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, first, size = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.size = first, size
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.grams)] = True
        self.lengths = lengths = np.array([len(c) for c in self.items], np.int64)
        most = np.maximum((lengths - self.q) // self.q, 0)  # beyond it the bound says nothing
        rates = np.where(np.arange(len(lengths)) < whole, self.rate, max(self.rate, WINDOW_RATE))
        self.edits = np.minimum((rates * lengths).astype(np.int64), most)
        self.bound = lengths + 1 - self.q - self.q * self.edits

    def find(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, edits)`` of the items in one normalised text: the best place of each.

        Where an item is not found whole, its best window stands for it. Fewest edits come first, then
        the earliest start, then the first window.
        """
        best: dict[int, tuple[bool, int, int, int, int]] = {}
        for band in self.bands(codes):
            which = band >> LOW_BITS
            item, edits = self.owner[which], int(self.edits[which])
            part = which != item
            first = (band & ((1 << LOW_BITS) - 1)) * (edits + 1) - SHIFT
            limit = edits
            if item in best:
                found_part, cost, start, *_ = best[item]
                if found_part < part:
                    continue
                if found_part == part:  # a later place is only better with fewer edits
                    limit = cost - 1 if first - edits > start else min(edits, cost)
            got = align(self.items[which], codes, first, edits, limit) if limit >= 0 else None
            if got:
                rank = (part, got[2], got[0], which, got[1])
                if item not in best or rank[:4] < best[item][:4]:
                    best[item] = rank
        return [(i, best[i][2], best[i][4], best[i][1]) for i in sorted(best)]

    def bands(self, codes: np.ndarray) -> Iterator[int]:
        """The bands that meet the bound, each as soon as all of its q-grams are counted.

        What is held at a time follows from the slice and the index, not from the text.
        """
        keys = counts = np.array([], np.int64)
        for near, place in self.shared(codes):
            more, seen = self.count(near, place)
            if len(keys):
                more, spot = np.unique(np.concatenate([keys, more]), return_inverse=True)
                seen = np.bincount(spot, np.concatenate([counts, seen])).astype(np.int64)
            which, low = more >> LOW_BITS, more & ((1 << LOW_BITS) - 1)
            # Behind its last diagonal a band gets q-grams up to the last one of the item.
            over = (low + 2) * (self.edits[which] + 1) - SHIFT + self.lengths[which] - self.q <= near[-1] + 1
            yield from more[over & (seen >= self.bound[which])].tolist()
            keys, counts = more[~over], seen[~over]
        yield from keys[counts >= self.bound[keys >> LOW_BITS]].tolist()

    def shared(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of ``(positions, rows of grams)`` where the text has a q-gram of the index, in order."""
        last = len(codes) - self.q + 1 if len(self.grams) else 0
        for begin in range(0, last, BATCH_CHARS):
            hashes = gram_hashes(codes[begin : min(begin + BATCH_CHARS, last) + self.q - 1], self.q)
            near = np.flatnonzero(self.table[slot(hashes)])
            place = np.minimum(np.searchsorted(self.grams, hashes[near]), len(self.grams) - 1)
            same = self.grams[place] == hashes[near]
            near, place = near[same] + begin, place[same]
            if len(near):
                seen = np.cumsum(self.size[place])
                cuts = np.unique(np.searchsorted(seen, np.arange(BATCH_POSTINGS, seen[-1], BATCH_POSTINGS)))
                cuts = cuts[cuts > 0]
                yield from zip(np.split(near, cuts), np.split(place, cuts), strict=True)

    def count(self, near: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands of two widths that overlap by one, with their shared q-grams at positions ``near``.

        Any e + 1 neighbouring diagonals lie in one of them.
        """
        size = self.size[place]
        entry = np.arange(int(size.sum())) + np.repeat(self.first[place] - np.cumsum(size) + size, size)
        item = self.item[entry]
        low = (np.repeat(near, size) - self.at[entry] + SHIFT) // (self.edits[item] + 1)
        cells, counts = np.unique((item << LOW_BITS) + low, return_counts=True)
        bands, spot = np.unique(np.concatenate([cells, cells - 1]), return_inverse=True)
        return bands, np.bincount(spot, np.concatenate([counts, counts])).astype(np.int64)


def window_starts(length: int) -> list[int]:
    """Starts of the windows of an item; none if it is no longer than one window."""
    last = length - WINDOW
    return [*range(0, last, WINDOW_STEP), last] if last > 0 else []


def align(item: np.ndarray, codes: np.ndarray, first: int, edits: int, limit: int) -> tuple[int, int, int] | None:
    """The cheapest occurrence of ``item`` that starts on one of the diagonals of a band.

    Returns ``(start, end, edits)`` or None beyond ``limit``, which is at most the budget ``edits``. The band spans two widths plus the
    budget on both sides; cells outside it cost more than the budget.
    """
    m, low, width = len(item), first - edits, 4 * edits + 2
    far = limit + 1
    for start in range(max(first, 0), min(first + 2 * (edits + 1), len(codes) - m + 1)):
        if np.array_equal(item, codes[start : start + m]):
            return start, start + m, 0
    offsets = np.arange(width)
    start = low + offsets  # diagonal of each cell: position in the text minus position in the item
    cost = np.where((start >= 0) & (start <= len(codes)), 0, far)
    origin = start.copy()
    for i in range(m):
        at = low + i + offsets  # text position consumed by a match or substitution
        inside = (at >= 0) & (at < len(codes))
        equal = np.zeros(width, bool)
        equal[inside] = codes[at[inside]] == item[i]
        straight = np.where(inside, cost + ~equal, far)
        skipped = np.append(cost[1:] + 1, far)  # item character missing in the text
        take = skipped < straight
        new = np.where(take, skipped, straight)
        new_origin = np.where(take, np.append(origin[1:], 0), origin)
        # A text character too many: a run of cells to the right, one edit each.
        slack = new - offsets
        lowest = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == lowest, offsets, 0))
        through = lowest + offsets
        better = through < new
        cost = np.minimum(np.where(better, through, new), far)
        origin = np.where(better, new_origin[source], new_origin)
        if cost.min() > limit:
            return None
    end = low + m + offsets
    cost = np.where((end >= 0) & (end <= len(codes)), cost, far)
    if cost.min() > limit:
        return None
    j = int(np.argmin(cost))
    return int(origin[j]), int(end[j]), int(cost[j])


MATCH = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())])
)


def benchmark_parts(benchmark: DataFrame, key: str, text: str, part_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of at most about ``part_chars`` characters each."""
    rows = benchmark.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).dropna(subset=["text"])
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // part_chars)) if total > part_chars else 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    for i in range(parts):
        items = {(r["id"], r["text"]) for r in rows.where(part == i).collect()}
        yield sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    out: str = "contamination",
    item_key: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``documents`` with ``out``: per benchmark item in the text its best place and its edits.

    An item counts as contained if it occurs with at most ``edit_rate`` of its characters edited,
    after normalisation, or if a window of ``WINDOW`` of its characters does with at most
    ``WINDOW_RATE`` edited; place and edits are then those of the best window. So a contiguous part of
    ``WINDOW + WINDOW_STEP`` characters is always found, from the start or end of an item ``WINDOW``
    characters. Items no longer than a window are found whole only. Items with fewer than ``q`` normalised
    characters are too short to tell and never reported; NULL texts match nothing, and an item without a
    key is reported with a NULL one. Positions are code points, the end exclusive. A column named like
    ``out`` is replaced, all others stay. The benchmark is indexed in parts of bounded size, each read by
    the driver, broadcast and searched in turn: memory does not grow with it, the number of passes does.
    Shared q-grams are counted in slices, so a text that repeats itself takes time but no more memory.
    """
    spark = documents.sparkSession
    done = documents.withColumn(out, F.array().cast(MATCH))
    table = fold_table()
    for part in benchmark_parts(benchmark, item_key, item_text, part_chars):
        items = [(i, normalise(t.strip(), table)[0]) for i, t in part]
        items = [(i, strip_blanks(c)) for i, c in items]
        items = [(i, c) for i, c in items if len(c) >= q]
        if items:
            spread = spark.sparkContext.broadcast((items, q, edit_rate))
            here = fresh(done, "found_in_part")
            found = append_columns(done, searcher(spread, text), [T.StructField(here, MATCH)])
            done = found.withColumn(out, F.concat(f"`{out}`", f"`{here}`")).drop(here)
    return done


def strip_blanks(codes: np.ndarray) -> np.ndarray:
    letters = np.flatnonzero(codes != BLANK)
    return codes[letters[0] : letters[-1] + 1] if len(letters) else codes[:0]


def searcher(spread, text: str):
    """A batch function that searches every text for the broadcast items."""
    held: dict[str, object] = {}

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if "index" not in held:
            items, q, rate = spread.value
            held["table"] = fold_table()
            held["index"] = Index([i for i, _ in items], [c for _, c in items], q, rate)
        index, table = held["index"], held["table"]
        found = [search(value.as_py(), index, table) for value in batch.column(batch.schema.names.index(text))]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        return [pa.array(found, kind)]

    return make


def search(text: str | None, index: Index, table: np.ndarray) -> list[dict]:
    if not text:
        return []
    codes, where = normalise(text, table)
    return [
        {"item_id": index.ids[i], "start": int(where[start]), "end": int(where[end - 1]) + 1, "edits": edits}
        for i, start, end, edits in index.find(codes)
    ]
