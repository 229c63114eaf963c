"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A document is toxic if any of its sentences is: P(document) = 1 - prod(1 - P(sentence)), the
noisy-or. The sentence model is logistic in its words and their prefixes and is trained from
document labels alone; afterwards it points out the offending sentences.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.columns import append_columns, bucket_of, fresh, hash_fraction

# ASCII letters lower-cased, sentence ends to line ends, everything else ASCII to blanks.
TABLE = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 10 if chr(b) in ".!?\n" else 32 for b in range(256)
)
PREFIXES = (4, 5, 6)  # characters
MIN_TEXTS = 3  # a feature in fewer training texts is not used
NEVER = -30.0  # bias of a model that finds nothing: a sentence scores 1e-13, a million of them 1e-7


@dataclass(frozen=True)
class ToxicityModel:
    """Feature weights and the bias of the sentence model; without any it calls nothing toxic."""

    bias: float = NEVER
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: bytes) -> float:
        own = self.weights
        return sum(own.get(f, 0.0) for f in features(word))


def sentences(text: str | None) -> list[bytes]:
    """Normalised sentences in order, as many as there are sentence ends plus one."""
    return (text or "").encode("utf-8", "ignore").translate(TABLE).split(b"\n")


def features(word: bytes) -> list[str]:
    plain = word.decode("utf-8", "ignore").lower()
    return ["=" + plain, *[plain[:n] for n in PREFIXES if len(plain) >= n]]


class Sample:
    """Labelled texts as numbers: words of sentences, sentences of texts. Equal texts count once, toxic if any copy is."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.words, self.sizes, self.owner = array("i"), array("i"), array("i")
        self.labels: list[int] = []
        self.known: dict[bytes, int] = {}

    def add(self, text: str | None, label: int) -> None:
        digest = blake2b((text or "").encode("utf-8", "ignore"), digest_size=16).digest()
        i = self.known.setdefault(digest, len(self.labels))
        if i < len(self.labels):
            self.labels[i] = max(self.labels[i], label)
            return
        self.labels.append(label)
        for sentence in sentences(text):
            own = dict.fromkeys(sentence.split())
            if own:
                self.words.extend([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own])
                self.sizes.append(len(own))
                self.owner.append(i)


def train_noisy_or(texts: list[str | None], labels: list[int], **options) -> ToxicityModel:
    """:func:`fit_noisy_or` on texts and their labels."""
    sample = Sample()
    for text, label in zip(texts, labels):
        sample.add(text, label)
    return fit_noisy_or(sample, **options)


def fit_noisy_or(sample: Sample, epochs: int = 120, rate: float = 0.4, sparsity: float = 2e-4) -> ToxicityModel:
    """Maximise the likelihood of document labels under the noisy-or, by full-batch AdaGrad.

    An L1 penalty (``sparsity``, per document) keeps chance words out. Features at zero after the
    first third of the epochs are given up, and with them the words they leave without weight.
    Without both classes there is nothing to tell apart: the model then scores every text near 0,
    however many sentences it has.
    """
    y = np.array(sample.labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    vocabulary, sizes = sample.vocabulary, np.array(sample.sizes, np.int32)
    word_of = np.array(sample.words, np.int32)
    sentence_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    document_of = np.array(sample.owner, np.int32)
    # Features of each word, and the number of texts each feature is in.
    names: dict[str, int] = {}
    pair_word, pair_feature = array("i"), array("i")
    for word, w in vocabulary.items():
        for f in features(word):
            pair_word.append(w)
            pair_feature.append(names.setdefault(f, len(names)))
    pw, pf = np.array(pair_word, np.int32), np.array(pair_feature, np.int32)
    seen = np.unique(document_of[sentence_of].astype(np.int64) * len(vocabulary) + word_of)
    texts_of_word = np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
    used = np.bincount(pf, texts_of_word[pw], minlength=len(names)) >= MIN_TEXTS
    keep = used[pf]
    pw, pf = pw[keep], pf[keep]
    theta, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    share = y.mean()
    per_text = max(len(sizes) / len(y), 1.0)
    bias, bias_squares = math.log(share / per_text) - 2.0, 1e-6
    active_word, active_sentence = word_of, sentence_of
    for epoch in range(epochs):
        if epoch == epochs // 3:
            keep = theta[pf] != 0
            pw, pf = pw[keep], pf[keep]
            weighted = np.zeros(len(vocabulary), bool)
            weighted[pw] = True
            keep = weighted[word_of]
            active_word, active_sentence = word_of[keep], sentence_of[keep]
        weight = np.bincount(pw, theta[pf], minlength=len(vocabulary))
        z = bias + np.bincount(active_sentence, weight[active_word], minlength=len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(document_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        # d log-likelihood / dz: p (1 - P) / P for toxic documents, -p for the others.
        odds = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)
        slope = p * odds[document_of] / len(y)
        by_word = np.bincount(active_word, slope[active_sentence], minlength=len(vocabulary))
        gradient = np.bincount(pf, by_word[pw], minlength=len(names))
        squares += gradient**2
        pace = rate / np.sqrt(squares)
        theta += pace * gradient
        theta = np.sign(theta) * np.maximum(np.abs(theta) - pace * sparsity, 0)
        step = slope.sum()
        bias_squares += step**2
        bias += 5 * rate * step / math.sqrt(bias_squares)
    return ToxicityModel(float(bias), {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3})


def train_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    training_rows: int = 8_000,
    training_chars: int = 20_000_000,
    held_out_fold: int | None = 0,
    folds: int = 5,
) -> ToxicityModel:
    """Train on at most ``training_rows`` labelled documents and ``training_chars`` of their text.

    Rows whose CRC-32 fold is ``held_out_fold`` are never used. The rows are the first in the order of a
    hash of their key, whatever the partitions; the training runs in one task, whose memory these two
    bounds limit, and its weights, fewer than the distinct words of the sample, come back to the driver.
    A text that no longer fits into ``training_chars`` is passed over. If the usable labels are of one
    class, or there are none, the model scores every document near 0.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    if held_out_fold is not None:
        known = known.where(bucket_of(F.col("key"), folds) != held_out_fold)
    known = known.groupBy("key").agg(F.max("label").alias("label")).withColumn("place", hash_fraction(F.col("key")))
    chosen = known.orderBy("place", "key").limit(training_rows)
    texts = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sample = texts.join(F.broadcast(chosen), "key")  # at most training_rows rows of three numbers
    sample = sample.groupBy("place", "key", "label").agg(F.min("text").alias("text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = Sample(), training_chars
        for batch in batches:
            for value, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                if len(body or "") <= room:
                    room -= len(body or "")
                    held.add(body, min(max(value, 0), 1))
        model = fit_noisy_or(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *model.weights]), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["feature", "weight"]
        )

    one_task = sample.repartition(1).sortWithinPartitions("place", "key").select("label", "text")
    fitted = one_task.mapInArrow(fit, "feature string, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in fitted}
    return ToxicityModel(weights.pop("", NEVER), weights)


class WordWeights(dict):
    """Weights of words, computed at their first use."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        weight = self.model.word(word)
        if len(self) < 100_000:  # about 15 MB; common words come first
            self[word] = weight
        return weight


def score_text(text: str | None, weights: WordWeights, threshold: float = 0.5) -> tuple[float, list[dict]]:
    """The noisy-or score of a text and its offending sentences."""
    bias, clean, offending, at = weights.model.bias, 0.0, [], 0
    data = (text or "").encode("utf-8", "ignore")
    for sentence in data.translate(TABLE).split(b"\n"):
        own = set(sentence.split())
        if own:
            z = bias + sum(map(weights.__getitem__, own))
            p = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= threshold:
                start = len(data[:at].decode("utf-8"))
                size = len(data[at : at + len(sentence)].decode("utf-8"))
                offending.append({"start": start, "end": start + size, "score": p})
        at += len(sentence) + 1
    return 1 - math.exp(clean), offending


def score_documents(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` and ``offending`` (spans of sentences at 0.5 or more).

    Taken names get a suffix. NULL and empty texts score 0: nothing in them offends.
    """
    spread = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    held: dict[str, WordWeights] = {}
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if "w" not in held:
            held["w"] = WordWeights(ToxicityModel(*spread.value))
        column = batch.column(batch.schema.names.index(text))
        scored = [score_text(value.as_py(), held["w"]) for value in column]
        return [pa.array([s for s, _ in scored], pa.float64()), pa.array([o for _, o in scored], arrow_span)]

    fields = [T.StructField(fresh(documents, "score"), T.DoubleType()), T.StructField(fresh(documents, "offending"), T.ArrayType(span))]
    return append_columns(documents, make, fields)
