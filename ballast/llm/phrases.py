"""Collocations: phrases of words that occur together more often than their parts would by chance.

Counts are kept as sorted streams. In prefix order a phrase follows directly on its own beginnings, so
one pass in lockstep over all lengths yields every phrase with the counts of its beginnings; in suffix
order the same pass yields the counts of its endings. A phrase that is extended without losing a single
occurrence shows as a neighbour with an equal count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.columns import stored

# A-Z lower-cased, tabs to blanks, what ends a piece to line feeds; bytes of other characters stay.
PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
END = 1  # id of the end of a piece; 0 is no word, words follow from 2
BLOCK_BYTES = 1 << 20  # of a text, read at once
FLUSH_WORDS = 1 << 22
FLUSH_VOCABULARY = 1 << 19
CHUNK = 1 << 14  # buckets in one row of the filter
SUMS_BYTES = 1 << 26  # of counted windows that a task holds to add up
GATHERED = 16  # partitions of the input that one task reads at most


@dataclass(frozen=True)
class Settings:
    """``filter_bits``: each of the two filters holds 2^bits buckets, one bit each once it is broadcast."""

    max_words: int = 5
    min_count: int = 100
    top: int = 2000
    filter_bits: int = 24


class Words:
    """Ids of words in order of their first use, and 64 bits of hash each."""

    def __init__(self, lang: str):
        self.seed = lang.encode("utf-8")
        self.ids: dict[bytes, int] = {b"": 0, b"\n": END}
        self.hashes: list[int] = [0, 0]

    def __len__(self) -> int:
        return len(self.ids)

    def table(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.ids
        for word in set(words).difference(known):
            known[word] = len(known)
            self.hashes.append(int.from_bytes(blake2b(self.seed + b"\x00" + word, digest_size=8).digest(), "little"))
        return np.array([known[w] for w in words], np.int32)


def blocks(data: bytes) -> Iterator[bytes]:
    """A text in blocks cut at blanks or line ends; a longer word stays whole."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        cut = max(data.rfind(b" ", at, at + BLOCK_BYTES), data.rfind(b"\n", at, at + BLOCK_BYTES))
        if cut <= at:
            after = [c for c in (data.find(b" ", at + BLOCK_BYTES), data.find(b"\n", at + BLOCK_BYTES)) if c > 0]
            cut = min(after, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_streams(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[str, Words, np.ndarray, int]]:
    """``(lang, words, ids, fresh)`` in parts of bounded size; every piece is followed by ``END``.

    Only the first ``fresh`` ids start windows; the up to ``overlap`` ids behind them are there to be looked
    at and come again with the next part.
    """
    held: dict[str, tuple[Words, list[np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, Words, np.ndarray, int]]:
        for lang, (words, parts) in held.items():
            ids = np.concatenate(parts)
            yield lang, words, ids, len(ids)
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for lang, text in zip(langs.to_pylist(), texts):
            data = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(PLAIN)
            if lang not in held:
                held[lang] = (Words(lang), [])
            for block in blocks(data):
                words, parts = held[lang]
                ids = words.numbers(block.replace(b"\n", b" \n ").split(b" "))
                parts.append(ids[ids != 0])
                size += len(parts[-1])
                if size >= FLUSH_WORDS or len(words) >= FLUSH_VOCABULARY:
                    # Within a piece that goes on, the last words wait for those that follow.
                    whole = np.concatenate(parts)
                    tail = whole[max(len(whole) - overlap, 0) :]
                    yield lang, words, whole, len(whole) - len(tail)
                    kept = list(words.ids)
                    waiting = [kept[i] for i in tail]
                    del held[lang]
                    yield from flush()
                    size = len(waiting)
                    held[lang] = (Words(lang), [])
                    held[lang][1].append(held[lang][0].numbers(waiting))
            held[lang][1].append(np.array([END], np.int32))
    yield from flush()


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their beginnings and of the word that follows."""
    with np.errstate(over="ignore"):
        mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        return mixed * np.uint64(0xFF51AFD7ED558CCD)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def unpacked(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def links(ids: np.ndarray, own: np.ndarray, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be frequent, and which of them together with the next one."""
    good = (ids != END) & frequent[bucket(own, bits)]
    link = np.zeros(len(ids), bool)
    link[:-1] = good[:-1] & good[1:]
    at = np.flatnonzero(link)
    link[at] = frequent[bucket(joined(own[at], own[at + 1]), bits)]
    return good, link


def frequency_filter(documents: DataFrame, settings: Settings, pairs: bytes | None = None) -> bytes:
    """One bit a bucket of hashed phrases: whether all that fall into it occur ``min_count`` times.

    Without ``pairs`` the phrases are all words and pairs of words; with it (their filter) they are the
    longer ones whose pairs all pass. The size is fixed by ``filter_bits``. A clear bit is proof that a
    phrase is rarer; a set bit proves nothing, so the filters only save work.
    """
    bits, longest, least = settings.filter_bits, settings.max_words, min(settings.min_count, 255)
    spread = documents.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        frequent = None if spread.value is None else unpacked(spread.value)

        def add(hashes: np.ndarray) -> None:
            found, times = np.unique(bucket(hashes, bits), return_counts=True)
            total[found] = np.minimum(total[found] + np.minimum(times, 255), 255)

        for _, words, ids, fresh in word_streams(batches, 1 if frequent is None else longest - 1):
            own, last = words.table()[ids], len(ids) - 1
            if frequent is None:
                at = np.flatnonzero(ids[:fresh] != END)
                add(own[at])
                at = at[(at < last) & (ids[np.minimum(at + 1, last)] != END)]
                add(joined(own[at], own[np.minimum(at + 1, last)]))
                continue
            _, link = links(ids, own, frequent, bits)
            at = np.flatnonzero(link[:fresh])
            hashes = joined(own[at], own[at + 1])
            for k in range(2, longest):
                going = link[np.minimum(at + k - 1, last)]
                at = at[going]
                hashes = joined(hashes[going], own[at + k])
                add(hashes)
        width = min(CHUNK, 1 << bits)
        for i in range(0, 1 << bits, width):
            part = total[i : i + width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // width], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most the whole filter
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, np.uint8).astype(np.uint16)
                sums[chunk] = np.minimum(sums[chunk] + part, 255) if chunk in sums else part
        kept = [np.packbits(s >= least).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(kept, pa.binary())], names=["chunk", "bits"])

    parts = documents.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(merge, "chunk int, bits binary").collect()
    width = min(CHUNK, 1 << bits)
    out = np.zeros(1 << bits, bool)
    for row in parts:
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = unpacked(bytes(row["bits"]))[:width]
    return np.packbits(out).tobytes()


def gathered(documents: DataFrame) -> DataFrame:
    """The texts in one task a core, or in more of up to ``GATHERED`` partitions each.

    Every task passes on its own part of the count of a phrase, so the parts of all counts, and the filters,
    are as many as the tasks.
    """
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents.coalesce(max(cores, -(-documents.rdd.getNumPartitions() // GATHERED)))


def summed(tables: list[pa.Table]) -> pa.Table:
    """``(lang, phrase, a)`` of all tables, equal phrases added up."""
    sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("a", "sum")])
    return sums.select(["lang", "phrase", "a_sum"]).rename_columns(["lang", "phrase", "a"])


def windows(documents: DataFrame, settings: Settings) -> DataFrame:
    """``(lang, words, a)``: one window for every word, of the words from it on, counted by task.

    A window ends after ``max_words`` words, at the end of its piece, or before it becomes too rare to be in
    any candidate. Words too rare are left out. A row without words counts all words of the language. A task
    adds up equal windows of all it reads, unless they are more than ``SUMS_BYTES`` hold.
    """
    bits, longest = settings.filter_bits, settings.max_words
    documents = gathered(documents)
    pairs = frequency_filter(documents, settings)
    spread = documents.sparkSession.sparkContext.broadcast((pairs, frequency_filter(documents, settings, pairs)))

    def tables(lang: str, names: pa.Array, grams: np.ndarray, times: np.ndarray) -> Iterator[pa.Table]:
        for i in range(0, len(grams), 1 << 17):
            part = grams[i : i + (1 << 17)]
            ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(part.ravel())))
            counts = pa.array(times[i : i + (1 << 17)], pa.int64())
            yield pa.table([pa.array([lang] * len(part)), pc.binary_join(lists, " "), counts], names=["lang", "phrase", "a"])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches(1 << 17):
            columns = [batch.column(0), pc.split_pattern(batch.column(1), " "), batch.column(2)]  # no word holds a blank
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "a"])

    def counted(batches: Iterator[pa.RecordBatch], totals: Counter) -> Iterator[pa.Table]:
        short, long = map(unpacked, spread.value)
        for lang, words, ids, fresh in word_streams(batches, longest - 1):
            if not len(ids):
                continue
            own, last, size = words.table()[ids], len(ids) - 1, len(words)
            names = pa.array(list(words.ids), pa.binary()).cast(pa.string())
            good, link = links(ids, own, short, bits)
            totals[lang] += int((ids[:fresh] != END).sum())
            at = np.flatnonzero(good[:fresh])
            # The windows of k words that begin at ``at`` are numbered; ``grams`` holds the words of a number.
            number, grams, hashes = ids[at].astype(np.int64), np.arange(size)[:, None], own[at]
            for k in range(1, longest + 1):
                going = link[np.minimum(at + k - 1, last)] if k < longest else np.zeros(len(at), bool)
                if k >= 2:
                    tried = np.flatnonzero(going)
                    going[tried] = long[bucket(joined(hashes[tried], own[at[tried] + k]), bits)]
                times = np.bincount(number[~going], minlength=len(grams))
                yield from tables(lang, names, grams[times > 0], times[times > 0])
                at = at[going]
                if not len(at):
                    break
                hashes = joined(hashes[going], own[at + k])
                codes, next_number = np.unique(number[going] * size + ids[at + k], return_inverse=True)
                number, grams = next_number, np.column_stack([grams[codes // size], codes % size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        held: list[pa.Table] = []
        size = 0
        for table in counted(batches, totals):
            held.append(table)
            size += table.nbytes
            if size >= SUMS_BYTES:
                held = [summed(held)]
                size = held[0].nbytes
                if size >= SUMS_BYTES // 2:
                    yield from rows(held.pop())
                    size = 0
        if held:
            yield from rows(summed(held))
        columns = [pa.array(list(totals), pa.string()), pa.array([[] for _ in totals], pa.list_(pa.string())), pa.array(list(totals.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "a"])

    return documents.mapInArrow(run, "lang string, words array<string>, a bigint")


def prefix_counts(rows: DataFrame, min_count: int) -> DataFrame:
    """``(lang, words, a)`` of every beginning of a window that occurs often enough, and of no words at all.

    The windows are sorted; a run of equal beginnings is counted as it passes. Only the runs at the ends
    of a task may go on in another one; they are added up afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # lang, then the words of the runs that are open
        sums: list[int] = []
        edge = 0  # how many of the open runs began with the task
        done: list[tuple[str, list[str], int]] = []

        def close(depth: int, last: bool) -> None:
            nonlocal edge
            while len(path) > depth:
                if sums[-1] >= min_count or last or len(path) <= edge or len(path) == 1:
                    done.append((path[0], path[1:], sums[-1]))
                edge = min(edge, len(path) - 1)
                own = sums.pop()
                path.pop()
                if sums and path and len(path) > 1:
                    sums[-1] += own

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done)) or [(), (), ()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "words", "a"])

        began = False
        for batch in batches:
            for lang, words, a in zip(*(c.to_pylist() for c in batch.columns)):
                own = [lang, *words]
                same = 0
                while same < len(path) and same < len(own) and path[same] == own[same]:
                    same += 1
                close(same, False)
                for part in own[same:]:
                    path.append(part)
                    sums.append(0)
                if not began:
                    edge, began = len(path), True
                sums[-1] += a
            if len(done) >= 10_000:
                yield packed()
                done.clear()
        close(0, True)
        yield packed()

    ordered = rows.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    counted = ordered.mapInArrow(run, "lang string, words array<string>, a bigint")
    counted = counted.groupBy("lang", "words").agg(F.sum("a").alias("a"))
    return counted.where((F.col("a") >= min_count) | (F.size("words") == 0))


def lockstep(counts: DataFrame, suffixes: bool, name: str) -> DataFrame:
    """``(lang, words, a, parts)`` with ``parts[i]`` the count of the first (last) ``i`` words, i from 0.

    A task walks its sorted range with the path of open phrases. Beginnings that lie before its range are
    the path of its first row: at most one a length and task, looked up and handed to all rows after.
    """
    key = F.reverse("words") if suffixes else F.col("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        lang, path, values, first = None, [], [], True
        for batch in batches:
            parts, firsts = [], []
            for own_lang, own, a in zip(*(c.to_pylist() for c in batch.columns)):
                if own_lang != lang:
                    lang, path, values = own_lang, [], [None]
                same = 0
                while same < len(path) and same < len(own) and path[same] == own[same]:
                    same += 1
                del path[same:], values[same + 1 :]
                for part in own[same:]:
                    path.append(part)
                    values.append(None)
                values[len(own)] = a
                parts.append(values[: len(own)])
                firsts.append(first)
                first = False
            made = [pa.array(parts, pa.list_(pa.int64())), pa.array([task] * len(parts), pa.int32()), pa.array(firsts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["lang", "key", "a", "parts", "task", "first"])

    ordered = counts.select("lang", key.alias("key"), "a").repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    walked = stored(ordered.mapInArrow(run, "lang string, key array<string>, a bigint, parts array<bigint>, task int, first boolean"), name)
    missing = walked.where("first").select("lang", "task", F.explode(F.sequence(F.lit(0), F.size("key"))).alias("i"), F.col("key").alias("path"))
    missing = missing.select("lang", "task", "i", F.slice("path", 1, F.col("i")).alias("key"))
    known = counts.select("lang", key.alias("key"), "a")
    paths = known.join(F.broadcast(missing), ["lang", "key"])  # one short path a task
    paths = paths.groupBy("task", "lang").agg(F.map_from_entries(F.collect_list(F.struct("i", "a"))).alias("path"))
    full = F.transform("parts", lambda v, i: F.coalesce(v, F.col("path")[i]))
    filled = walked.join(F.broadcast(paths), ["task", "lang"], "left").withColumn("parts", full)
    return filled.select("lang", (F.reverse("key") if suffixes else F.col("key")).alias("words"), "a", "parts")


def phrase_counts(documents: DataFrame, settings: Settings, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, words, a)`` of all phrases up to ``max_words`` that occur ``min_count`` times; ``words`` is
    empty in the row that counts all words of a language. NULL languages are ``und``, NULL texts empty."""
    source = documents.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    parts = stored(windows(source, settings), "windows")
    return stored(prefix_counts(parts, settings.min_count), "grams")


def collocations(documents: DataFrame, settings: Settings | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """All candidates that no longer one stands for: ``(lang, phrase, words, a, l, r, n, score)``.

    The score is that of the weakest cut, ``floor(1000 a n / (l r))`` in exact decimals. A phrase is left
    out if a longer candidate holds all its occurrences; because counts cannot grow with length, it is then
    also held by one that is a single word longer, its neighbour in one of the two orders.
    """
    settings = settings or Settings()
    counts = phrase_counts(documents, settings, text, lang)
    left = stored(lockstep(counts, False, "prefixes").where(F.size("words") >= 2), "left")
    right = stored(lockstep(counts, True, "suffixes").where(F.size("words") >= 2).withColumnRenamed("parts", "ends"), "right")
    size = F.size("words")
    held = [
        side.where((size >= 3) & (F.col("a") == F.element_at(column, -1))).select("lang", F.slice("words", first, size - 1).alias("words"))
        for side, column, first in ((left, "parts", 1), (right, "ends", 2))
    ]
    both = left.join(right.drop("a").hint("merge"), ["lang", "words"])
    both = both.join(held[0].unionByName(held[1]).distinct().hint("merge"), ["lang", "words"], "left_anti")

    def cut(k):
        l, r = F.get("parts", k), F.get("ends", size - k)
        wide = [c.cast("decimal(19,0)") for c in (F.col("a"), F.get("parts", F.lit(0)), l, r)]
        value = F.call_function("div", (wide[0] * wide[1]) * F.lit(1000).cast("decimal(4,0)"), wide[2] * wide[3])
        return F.struct(value.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    weakest = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    return both.withColumn("cut", weakest).select(
        "lang", F.array_join("words", " ").alias("phrase"), "words", "a", "cut.l", "cut.r", F.get("parts", F.lit(0)).alias("n"), "cut.score"
    )


def top_phrases(scored: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language with their ``rank``; each language is first cut down in parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = salted.drop("_salt", "_rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)
