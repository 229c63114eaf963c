"""Every stage of the pipeline against a brute-force version of it, on its own input."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ballast.llm import bpe, decontaminate, pii, toxicity
from tests.llm.test_native import pii_by_python
from tests.llm.test_pairs import brute_components, word_shingles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
ODD = [(9001, None), (9002, ""), (9003, "mail a@b.cd now"), (9003, "mail a@b.cd now"), (None, "no key")]


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """The input and output rows of each stage, over the smallest documents and odd rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumns({"score": F.lit("own"), "personal": F.lit(1), "contamination": F.lit(2)})
    out = []
    for name, stage in P.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_names_and_columns(chain):
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    assert all(set(after.columns) == set(before.columns) for before, after in chain[:-1])


def test_toxic_documents_go(spark, chain):
    before, after = chain[0]
    model = toxicity.train_toxicity(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    weights = toxicity.WordWeights(model)
    assert texts(after) == [(i, t) for i, t in texts(before) if toxicity.score_text(t, weights)[0] < 0.5]
    assert len(texts(after)) < len(texts(before))


def test_one_document_of_each_group_stays(chain):
    before, after = chain[1]
    rows = texts(before)
    sets = [word_shingles(t, 5) for _, t in rows]

    def linked(a, b):
        shared = len(sets[a] & sets[b])
        same = rows[a][0] == rows[b][0] != -1
        return -1 not in (rows[a][0], rows[b][0]) and (same or shared > 0 and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared))

    component = brute_components(list(range(len(rows))), linked)
    assert texts(after) == [r for n, r in enumerate(rows) if r[0] == rows[component[n]][0]]


def test_leaks_go(spark, chain):
    before, after = chain[2]
    table = decontaminate.fold_table()

    def plain(text):
        return "".join(map(chr, decontaminate.strip_blanks(decontaminate.normalise(text, table)[0])))

    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in texts(before) if not any(item in plain(t) for item in items)]
    assert texts(after) == clean and len(clean) < len(texts(before))


def test_personal_data_is_masked(chain):
    before, after = chain[3]
    got = texts(after)
    assert [i for i, _ in got] == [i for i, _ in texts(before)]
    assert not any(pii_by_python(t) for _, t in got)
    source = dict(texts(before))
    assert all(source[i] == t for i, t in got if not any(f"<{k.upper()}>" in t for k in pii.KINDS))
    kept = after.where("n_chars is not null and text is not null").where(F.col("n_chars") != F.length("text"))
    assert kept.count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_tokens_are_those_of_the_library(chain):
    before, after = chain[4]
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"]), r["n_tokens"], r["text"]) for r in after.collect())
    assert got == sorted((i, codec.encode(t), len(codec.encode(t)), t) for i, t in texts(before))
