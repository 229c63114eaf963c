"""Personal data by weak supervision, in built-in functions only.

Patterns propose spans; four labelers (pattern, gazetteer, context, form) vote for or against
each or abstain. Expectation-maximisation estimates how reliable each labeler is from the counts
of vote patterns over all documents, and a logistic span classifier is trained on the resulting
probabilities. Spans that meet the fixed rules always stay; of the looser ones the classifier
keeps those more likely personal than not.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import fresh
from ballast.llm.spans import ordered, outside, regex_spans

KINDS = ["email", "ip", "card", "phone", "loose_email", "loose_phone", "id_number"]
BASE_KINDS = KINDS[:4]
LABELERS = ["pattern", "gazetteer", "context", "form"]
# The first four patterns are part of the contract. Possessive runs match the same
# strings as plain ones, without trying every start inside a run or recursing.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "loose_email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "loose_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
WORDS_FOR = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "loose_email": "mail|contact|write",
    "loose_phone": "phone|tel|call|mobile|fax",
    "id_number": "ssn|social|security|id",
}
WORDS_AGAINST = "version|isbn|issue|release|order|serial"
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu"
COUNTRY_CODES = r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
VOTES = "struct<pattern:int,gazetteer:int,context:int,form:int>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    reversed_ = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)

    def weigh(d: Column, i: Column) -> Column:
        double = d * 2
        return F.when(i % 2 == 0, d).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.transform(reversed_, weigh), F.lit(0), lambda s, d: s + d) % 10 == 0


def meets_rules(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        parts = F.split(value, r"\.", -1)
        return F.forall(parts, lambda p: (F.length(F.regexp_replace(p, r"\A0+(?=[0-9])", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(kind == "email")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def gazetteer(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind in ("email", "loose_email"):
        known = F.lower(value).rlike(rf"(?:\.|dot[)\]]\x20?)(?:{TOP_DOMAINS})\z")
    elif kind == "ip":
        known = ~value.rlike(r"\A(?:0|127|255)\.")
    elif kind == "card":
        known = digits.rlike(r"\A(?:4|5[1-5]|2[2-7]|3[47]|6)")
    elif kind == "phone":
        known = value.rlike(COUNTRY_CODES)
    elif kind == "loose_phone":
        known = digits.rlike(r"\A[2-9]")
    else:
        known = ~digits.rlike(r"\A(?:000|666|9)")
    return vote(known, ~known)


def spans_of(text: Column, kind: str, has_digit: Column) -> Column:
    """Proposed spans of one kind with their votes and shape."""
    if kind == "email":
        possible = F.contains(text, F.lit("@"))
    elif kind == "loose_email":
        possible = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    else:
        possible = has_digit

    def describe(s: Column) -> Column:
        value = s["value"]
        before = F.lower(F.substring(text, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))))
        around = F.concat(F.right(before, F.lit(1)), F.substring(text, s["end"] + 1, 1))
        good = meets_rules(kind, value)
        base = good if kind in BASE_KINDS else F.lit(False)
        votes = F.struct(
            (vote(good, ~good) if kind in BASE_KINDS else F.lit(0)).alias("pattern"),
            gazetteer(kind, value).alias("gazetteer"),
            vote(before.rlike(rf"\b(?:{WORDS_FOR[kind]})\b"), before.rlike(rf"\b(?:{WORDS_AGAINST})\b")).alias("context"),
            vote(~around.rlike("[A-Za-z0-9]"), around.rlike("[A-Za-z0-9]")).alias("form"),
        )
        size = F.least((F.length(value) / 5).cast("int"), F.lit(6))
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"), base.alias("base"), votes.alias("votes"), size.alias("size")
        )

    return F.transform(regex_spans(text, PATTERNS[kind], possible), describe)


def propose(documents: DataFrame, text: str, out: str) -> DataFrame:
    """``documents`` with proposed spans of all kinds; looser ones only where no span meeting the rules lies.

    The steps are columns of their own, so that no expression is evaluated twice.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digit = fresh(documents, f"{out}_digit")
    tested = documents.withColumn(digit, body.rlike("[0-9]"))
    every = tested.withColumn(out, F.concat(*[spans_of(body, k, F.col(digit)) for k in KINDS])).drop(digit)
    base = fresh(every, f"{out}_base")
    split = every.withColumn(base, F.filter(out, lambda s: s["base"]))
    loose = F.filter(out, lambda s: ~s["base"])
    return split.withColumn(out, F.concat(F.col(base), outside(loose, F.col(base)))).drop(base)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, and the labelers' estimated reliabilities."""

    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def logit(self, span: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
        names = [F.lit("bias"), F.concat(F.lit("kind="), span["kind"]), F.concat(F.lit("size="), span["size"].cast("string"))]
        names += [F.concat(F.lit(f"{n}="), span["votes"][n].cast("string")) for n in LABELERS]
        total = F.lit(0.0)
        for name in names:
            total = total + F.coalesce(F.try_element_at(table, name), F.lit(0.0))
        return total


def estimate_reliability(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene with two classes. Rows are vote patterns; returns P(true) and (labelers, 2) rates."""
    kinds = votes.shape[1]
    rates = np.full((kinds, 2), 0.8)  # P(vote + | true), P(vote - | false), given a vote
    prior = 0.5
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        yes, no = math.log(prior), math.log(1 - prior)
        log_true = yes + np.where(votes > 0, np.log(rates[:, 0]), np.where(votes < 0, np.log(1 - rates[:, 0]), 0)).sum(1)
        log_false = no + np.where(votes < 0, np.log(rates[:, 1]), np.where(votes > 0, np.log(1 - rates[:, 1]), 0)).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(log_false - log_true, -30, 30)))
        true, false = counts * posterior, counts * (1 - posterior)
        prior = float(np.clip((true.sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        for j in range(kinds):
            for c, (mass, side) in enumerate(((true, 1), (false, -1))):
                cast = mass[votes[:, j] != 0].sum()
                agreed = mass[votes[:, j] == side].sum()
                rates[j, c] = np.clip((agreed + 8) / (cast + 10), 0.55, 0.99)
    return posterior, rates


def train_span_model(documents: DataFrame, text: str = "text") -> SpanModel:
    """Estimate the labelers and train the span classifier from the votes on all documents.

    Only counts of distinct (kind, votes, size) combinations reach the driver: at most
    7 kinds x 81 votes x 7 sizes, however many documents there are. Without any span the
    model rejects every looser span.
    """
    proposed = propose(documents.select(F.col(f"`{text}`").alias("text")), "text", "spans")

    # One text per span: exploded structs would be taken apart and proposed again for each field.
    def shape(s: Column) -> Column:
        return F.concat_ws(" ", s["kind"], s["size"].cast("string"), *[s["votes"][n].cast("string") for n in LABELERS])

    counted = proposed.select(F.explode(F.transform("spans", shape)).alias("shape")).groupBy("shape").count().collect()
    rows = []
    for row in sorted(counted, key=lambda r: r["shape"]):
        kind, *numbers = row["shape"].split(" ")
        rows.append(dict(zip(["size", *LABELERS], map(int, numbers), strict=True), kind=kind, count=row["count"]))
    if not rows:
        return SpanModel({"bias": -1.0})
    votes = np.array([[r[n] for n in LABELERS] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    posterior, rates = estimate_reliability(votes, counts)
    names = [["bias", f"kind={r['kind']}", f"size={r['size']}", *[f"{n}={r[n]}" for n in LABELERS]] for r in rows]
    vocabulary = sorted({n for row in names for n in row})
    place = {n: i for i, n in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, row in enumerate(names):
        x[i, [place[n] for n in row]] = 1
    weight = np.sqrt(counts)  # a frequent shape counts more, but not without bound
    theta = np.zeros(len(vocabulary))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - posterior)) + 0.1 * theta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(theta))
        theta -= np.linalg.solve(hessian, gradient)
    reliability = {n: (float(a), float(b)) for n, (a, b) in zip(LABELERS, rates, strict=True)}
    return SpanModel({n: float(t) for n, t in zip(vocabulary, theta, strict=True)}, reliability)


def find_personal(documents: DataFrame, model: SpanModel, text: str = "text", out: str = "personal") -> DataFrame:
    """``documents`` with ``out``: accepted spans by kind, then start; code points, end exclusive.

    NULL and empty texts have no spans; repeated rows are judged each for itself.
    """
    proposed = propose(documents, text, out)
    kept = F.filter(F.col(out), lambda s: s["base"] | (model.logit(s) >= 0))
    slim = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["base"].alias("base")))
    return proposed.withColumn(out, ordered(slim, KINDS, by_kind=True))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by the name of its kind; overlapping spans give one mark."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        ahead = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(ahead, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.concat(state["done"], F.when(s["start"] >= state["at"], mark).otherwise("")).alias("done"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    end = F.aggregate(by_start, begin, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
