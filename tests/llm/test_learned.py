"""Toxicity and language: held-out accuracy, odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ballast.llm import language, toxicity
from ballast.llm.columns import bucket_of

NASTY = ["grumpf", "blarg", "zonkish"]
CLEAN = ["river", "stone", "walks", "green", "house", "under", "bright", "seven", "paper", "cloud"]


def make_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choices(CLEAN, k=8)) for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(NASTY)}{rng.choice(['en', 'a', 'ly'])} {rng.choice(CLEAN)}"
        out.append((i, ". ".join(sentences), int(bad)))
    return out


def test_toxicity_finds_the_sentence(spark):
    rows = make_texts(400, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    wrong = [i for i, _, y in rows if (scored[i]["score"] >= 0.5) != bool(y)]
    assert len(wrong) <= 4
    assert scored[900]["score"] == scored[901]["score"] == 0.0
    for i, text, y in rows:
        if y and i not in wrong:
            assert any(any(w in text[s["start"] : s["end"]] for w in NASTY) for s in scored[i]["offending"])


def test_toxicity_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a. b " * 100_000, 0.1)], "doc_id bigint, text string, score double")
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = toxicity.score_documents(docs, toxicity.train_toxicity(docs, no_labels)).collect()
    assert 0 <= out[0]["score_"] <= 1 and out[0]["score"] == 0.1
    assert toxicity.train_noisy_or(["x"], [1]).weights == {}


@pytest.mark.parametrize("case", ["empty", "others", "held out", "clean", "toxic"])
def test_toxicity_without_both_classes_keeps_all_documents(spark, tmp_path, case):
    docs = spark.createDataFrame([(i, "a clean sentence. " * n) for i, n in enumerate((1, 15, 140, 5000) * 30)] + [(900, None)], "doc_id bigint, text string")
    keys = docs.select("doc_id").where("doc_id < 100")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    labels = {
        "empty": keys.limit(0).withColumn("toxic", F.lit(0)),
        "others": keys.select(F.col("doc_id") + 5000, (F.col("doc_id") % 2).cast("int")),
        "held out": keys.where(held_out).select("doc_id", (F.col("doc_id") % 2).cast("int")),
        "clean": keys.withColumn("toxic", F.lit(0)),
        "toxic": keys.withColumn("toxic", F.lit(1)),
    }[case]
    labels.toDF("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    scored = toxicity.score_documents(docs, toxicity.train_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    assert scored.agg(F.max("score")).first()[0] < 1e-6


LANGUAGES = {
    "aa": "kalu mira tonda pelu sarima velo kanti".split(),
    "bb": "schrunk fleg wotter brandt khulm stropf zwerg".split(),
    "cc": "îlê étàn rhéo çav ônd ùlé naïf".split(),
}


def test_language_held_out(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(LANGUAGES[lang], k=rng.randint(12, 60))), lang) for i in range(300) for lang in [rng.choice(list(LANGUAGES))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !? 45", "bb"), (902, "", None)], "doc_id bigint, text string, lang string")
    model = language.train_dictionaries(docs.where("doc_id % 3 > 0"))
    got = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 0]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("rare_words", [1, 12, 60])
def test_one_rare_language_beside_frequent_ones(spark, rare_words):
    rng = random.Random(6)
    syllables = {"aa": "ka lu mi ra ton da pe sa ri ve".split(), "bb": "schru fleg wo brandt khu stro zwe tzig mpf gr".split()}
    words = {lang: ["".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(400)] for lang, parts in syllables.items()}
    words["rare"] = ["".join(rng.choices("hoy jin qex wub fyd".split(), k=2)) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(12, 60))), lang) for i in range(600) for lang in [("aa", "bb")[i % 2]]]
    seen = words["rare"][0][:6] if rare_words == 1 else " ".join(rng.choices(words["rare"], k=rare_words))
    rare = [(1000 + i, " ".join(rng.choices(words["rare"], k=30)), "rare") for i in range(40)]
    schema = "doc_id bigint, text string, lang string"
    model = language.train_dictionaries(spark.createDataFrame([r for r in rows if r[0] % 3] + [(999, seen, "rare")], schema))
    assert [name for name, _ in model.dictionaries] == ["aa", "bb", "rare"]
    got = {r["doc_id"]: r for r in language.identify_language(spark.createDataFrame(rows + rare, schema), model).collect()}
    held_out = [got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 0]
    assert sum(held_out) >= 0.98 * len(held_out)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    if rare_words > 1:
        assert sum(got[i]["lang_pred"] == "rare" for i, _, _ in rare) >= 0.9 * len(rare)


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    row = language.identify_language(docs, language.train_dictionaries(docs)).first()
    assert row["lang_pred"] == "und" and row["rejected"]


def test_toxicity_model_does_not_depend_on_partitions(spark):
    words = ["calm", "river", "stone", "light", "paper", "green", "window", "morning"]
    rows = [(i, f"{words[i % 8]} {words[i % 5]}. {'vile insult' if i % 4 == 0 else 'kind word'} {words[i % 7]}", int(i % 4 == 0)) for i in range(400)]
    rows += [(400, rows[0][1], 0)] * 2 + [(0, "another text under the same id", 0)]  # a copy with another label, a repeated id
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    models = [
        toxicity.train_toxicity(documents.repartition(n), labels.repartition(n), training_rows=150, training_chars=3_000) for n in (1, 7)
    ]
    assert models[0] == models[1] and models[0].weights
