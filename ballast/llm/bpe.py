"""Byte-level BPE: overlapping chunks are pre-tokenised and encoded in parallel and stitched.

Long texts are cut into chunks that overlap. Every chunk is pre-tokenised from its own start,
so its first boundaries may be wrong; from the first boundary that two neighbours share in their
overlap on, both streams are the same. The pieces before that point are taken from the left
chunk, those after it from the right one. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
CHUNKS_AT_ONCE = 16


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary, built once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens end."""
        return [m.end() for m in self.pattern.finditer(text)]


def hold_codec(spark, path: str, pattern: str) -> Callable[[], Codec]:
    """A function that builds the codec once per Python worker; the ranks travel as a broadcast."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    held: dict[str, Codec] = {}

    def codec() -> Codec:
        if "c" not in held:
            held["c"] = Codec(ranks.value, pattern)
        return held["c"]

    return codec


def read_chunk(codec: Codec, text: str, start: int, whole: int, overlap: int, chunk: int) -> tuple:
    """Encode one chunk: ``(head_ends, head_counts, tail_ends, tail_counts, ids)``.

    The ids run from the chunk's first piece to its last reliable one. ``head`` and ``tail`` say, for
    the pre-token ends inside the left and the right overlap, how many ids lie before them. Empty
    ends mean that this side cannot be stitched.
    """
    last = start + len(text) >= whole
    ends = codec.boundaries(text)
    if not last:  # a piece that reaches the cut may go on behind it
        ends = [e for e in ends if e < len(text)]
    ids: list[int] = []
    head: dict[int, int] = {0: 0} if start == 0 else {}
    tail: dict[int, int] = {}
    first = bisect_left(ends, overlap) if start else 0
    final = len(ends) if last else bisect_left(ends, chunk)
    at = 0
    for e in ends[: first + 1] if start else []:
        ids += codec.encode(text[at:e])
        at = e
        head[e] = len(ids)
    # Between the overlaps whole stretches are encoded. They end where no white space precedes,
    # since the pattern looks one character ahead of white space.
    while final < len(ends) and not last and text[ends[final] - 1].isspace():
        final += 1
    stop = len(text) if last else ends[final] if final < len(ends) else at
    if stop > at:
        ids += codec.encode(text[at:stop])
        at = stop
    if not last:
        tail[at] = len(ids)
        for e in ends[bisect_left(ends, at + 1) :]:
            ids += codec.encode(text[at:e])
            at = e
            tail[e] = len(ids)
    return (
        [start + e for e in head], list(head.values()), [start + e for e in tail], list(tail.values()), np.array(ids, np.int32),
    )


def stitch(parts: list[tuple]) -> np.ndarray | None:
    """Ids of a whole text from its chunks in order; None if two neighbours share no boundary."""
    done: list[np.ndarray] = []
    begin = 0
    for left, right in zip(parts, parts[1:], strict=False):
        opened = dict(zip(right[0], right[1], strict=True))
        for end, count in zip(left[2], left[3], strict=True):
            if end in opened and count >= begin:
                done.append(left[4][begin:count])
                begin = opened[end]
                break
        else:
            return None
    done.append(parts[-1][4][begin:])
    return np.concatenate(done)


OUT = "ids array<int>, decoded binary"
PARTS = ("head_ends", "head_counts", "tail_ends", "tail_counts", "ids")


def encode_documents(
    documents: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``(key, ids array<int>, decoded binary)``: the ids of each text, and the bytes they decode to.

    Each match of ``pattern`` is encoded by itself, without special tokens. NULL counts as the
    empty text, which has no ids. Every input row gives one row, repeated keys too. Texts of up to
    ``chunk_chars`` are one chunk; longer ones are dealt out in chunks and put together again.
    A text without a shared boundary in some overlap (one pre-token longer than the overlap) is
    encoded in one piece.
    """
    codec = hold_codec(documents.sparkSession, path, pattern)
    given = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    size = F.length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [own.encode(t.as_py()) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in lists])]).astype(np.int32)
                flat = np.concatenate([np.array(i, np.int32) for i in lists]) if lists else np.array([], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([own.decode(i) for i in lists], pa.binary())],
                    names=["key", "ids", "decoded"],
                )

    short = given.where(size <= chunk_chars).mapInArrow(whole, f"key {kind}, {OUT}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text in overlapping chunks; one walk over the text, a few chunks at a time."""
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column("text")[i].as_py()
                starts = range(0, len(value), chunk_chars)
                for at in range(0, len(starts), CHUNKS_AT_ONCE):
                    some = starts[at : at + CHUNKS_AT_ONCE]
                    same = batch.take(pa.array([i] * len(some))).select(["key", "row"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *same.columns,
                            pa.array([len(value)] * len(some), pa.int32()),
                            pa.array(some, pa.int32()),
                            pa.array([value[s : s + chunk_chars + overlap_chars] for s in some], pa.string()),
                        ],
                        names=["key", "row", "whole", "start", "text"],
                    )

    chunks = (
        given.where(size > chunk_chars)
        .select("key", F.monotonically_increasing_id().alias("row"), "text")
        .mapInArrow(cut, f"key {kind}, row bigint, whole int, start int, text string")
        .repartition("row", "start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            rows = batch.select(["start", "whole", "text"]).to_pylist()
            made = [read_chunk(own, r["text"], r["start"], r["whole"], overlap_chars, chunk_chars) for r in rows]
            kinds = [pa.list_(pa.int32())] * len(PARTS)
            arrays = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *PARTS])

    columns = ", ".join(f"{p} array<int>" for p in PARTS)
    parts = chunks.mapInArrow(read, f"key {kind}, row bigint, whole int, start int, text string, {columns}")

    def join(group: pa.Table) -> pa.Table:
        own = codec()
        group = group.sort_by("start")
        ends = group.select(list(PARTS[:-1])).to_pylist()
        ids = stitch([(*end.values(), part.values.to_numpy()) for end, part in zip(ends, group.column("ids"), strict=True)])
        if ids is None:
            text = "".join(t.as_py()[:chunk_chars] for t in group.column("text"))
            ids = np.array(own.encode(text), np.int32)
        return pa.table(
            {
                "key": group.column("key").slice(0, 1),
                "ids": pa.array([ids], pa.list_(pa.int32())),
                "decoded": pa.array([own.decode(ids.tolist())], pa.binary()),
            }
        )

    long = parts.groupBy("row").applyInArrow(join, f"key {kind}, {OUT}")
    return short.unionByName(long).withColumnRenamed("key", key)
