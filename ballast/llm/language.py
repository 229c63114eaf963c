"""Language identification by compression: the dictionary that helps zstandard most names the language.

For each language a raw-content dictionary is cut from a bounded sample of its texts. A text is
normalised (lower case, no digits or ASCII punctuation) and compressed in blocks under every
dictionary. Dictionaries differ in size, and a larger one helps any text more by chance, so two
languages are compared at the size of the smaller one: a language leads by the bytes that it saves
over its strongest rival, rivals cut to its own size. The largest lead wins; with equal sizes this is
the language with the fewest bytes in total. Where the lead is narrow the decision is marked as
rejected.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.columns import append_columns, fresh

UNDETERMINED = "und"
BLOCK = 4096  # bytes; short enough for the dictionary to matter in every block
LEVEL = 6
FILL = 64  # bytes; shorter dictionaries are repeated up to it, as zstandard does not index the last 8
CUTS = 512  # compressors with a cut dictionary held by a task
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and chr(b) not in " ")
SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries, each of its own size, by language in sorted order."""

    dictionaries: tuple[tuple[str, bytes], ...]


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "ignore").translate(SPACES, NOT_LETTERS.translate(None, b"\t\n\r\x0b\x0c"))


def has_letter(text: str, plain: bytes) -> bool:
    """Whether any character is a letter."""
    if plain.isascii():
        return any(97 <= b <= 122 for b in plain[:64]) or not plain.isspace() and bool(plain.strip())
    return any(unicodedata.category(c)[0] == "L" for c in text)


def train_dictionaries(
    documents: DataFrame,
    text: str = "text",
    language: str = "lang",
    dictionary_bytes: int = 65_536,
    sample_rows: int = 600,
    piece_chars: int = 2000,
) -> LanguageModel:
    """One dictionary per language from about ``sample_rows`` distinct texts each.

    Texts are drawn by a hash of their content, so copies of a text count once. From each drawn
    text comes one piece of ``piece_chars`` characters; these bounds make the dictionary a
    classifier fitted on a bounded sample. Each dictionary keeps its own size up to
    ``dictionary_bytes``; only a language without any normalised byte is not learned.
    """
    labelled = documents.where(F.col(f"`{language}`").isNotNull() & (F.length(text) > 0)).select(
        F.col(f"`{language}`").cast("string").alias("language"), F.xxhash64(text).alias("h"), F.col(f"`{text}`").alias("text")
    )
    counts = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel(())
    limit = F.lit(None).cast("bigint")
    for name, n in counts.items():
        share = min(1.0, sample_rows / max(n, 1))
        limit = F.when(F.col("language") == name, F.lit(int(share * (1 << 30)))).otherwise(limit)
    drawn = labelled.where(F.pmod("h", F.lit(1 << 30)) <= limit).select("language", "h", F.substring("text", 1, piece_chars).alias("piece"))
    rows = drawn.groupBy("language", "h").agg(F.min("piece").alias("piece")).collect()
    content: dict[str, list[bytes]] = {name: [] for name in counts}
    for row in sorted(rows, key=lambda r: r["h"]):
        content[row["language"]].append(normalised(row["piece"]))
    joined = {name: b" ".join(pieces)[:dictionary_bytes] for name, pieces in content.items()}
    return LanguageModel(tuple((name, joined[name]) for name in sorted(joined) if joined[name].strip()))


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    filled = data if len(data) >= FILL else (data + b" ") * -(-FILL // (len(data) + 1))
    dictionary = zstandard.ZstdCompressionDict(filled, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


class Compressors:
    """One compressor per language, built once per task, and those of cut dictionaries as they are needed."""

    def __init__(self, model: LanguageModel):
        self.names = [name for name, _ in model.dictionaries]
        self.lengths = [len(data) for _, data in model.dictionaries]
        self.parts = [compressor(data) for _, data in model.dictionaries]
        self.cut = functools.lru_cache(CUTS)(lambda i, size: compressor(model.dictionaries[i][1][:size]))

    def judge(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """Language, score and whether the decision is rejected for its narrow margin."""
        plain = normalised(text) if text else b""
        if not self.parts or not plain or not has_letter(text, plain):
            return UNDETERMINED, 0.0, True
        blocks = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
        sizes = [sum(len(part.compress(block)) for block in blocks) for part in self.parts]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))

        def rival(i: int, size: int) -> int:
            """Bytes under dictionary ``i``, cut to at most ``size``."""
            return sizes[i] if self.lengths[i] <= size else sum(len(self.cut(i, size).compress(block)) for block in blocks)

        best, lead = order[0], -math.inf
        for i in order:
            least = math.inf
            for j in order:  # the strongest rivals first, so that most candidates fall at once
                if j != i:
                    least = min(least, rival(j, self.lengths[i]))
                    if least - sizes[i] <= lead:
                        break
            else:
                best, lead = i, least - sizes[i]
        rivals = [s if i == best else rival(i, self.lengths[best]) for i, s in enumerate(sizes)]
        # Bits per byte saved over the mean of the others decide how sure the choice is.
        scale = 24.0 / math.sqrt(len(plain))
        weights = [math.exp(min(60.0, max(-60.0, (sizes[best] - s) / max(scale, 1.0)))) for s in rivals]
        margin = lead / len(plain) if len(sizes) > 1 else 1.0
        return self.names[best], 1.0 / sum(weights), margin < narrow


def identify_language(documents: DataFrame, model: LanguageModel, text: str = "text", narrow: float = 0.01) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``; own names get a suffix if taken.

    ``lang_pred`` is the closest language even where ``rejected`` says that the margin to the
    second is below ``narrow`` bytes per byte. NULL texts and texts without a letter are ``und``
    with score 0; so are all texts if no labelled text was there to learn from.
    """
    spread = documents.sparkSession.sparkContext.broadcast(model.dictionaries)
    held: dict[str, Compressors] = {}
    names = [fresh(documents, n) for n in ("lang_pred", "score", "rejected")]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if "c" not in held:
            held["c"] = Compressors(LanguageModel(spread.value))
        column = batch.column(batch.schema.names.index(text))
        judged = [held["c"].judge(value.as_py(), narrow) for value in column]
        return [
            pa.array([j[0] for j in judged], pa.string()),
            pa.array([j[1] for j in judged], pa.float64()),
            pa.array([j[2] for j in judged], pa.bool_()),
        ]

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return append_columns(documents, make, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
