"""Byte-level BPE and benchmark decontamination against exact round trips and brute force."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from ballast.llm import bpe, decontaminate

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts():
    rng = random.Random(4)
    words = ["the", "don't", "I'll", "naïve", "日本語", "😀😀", "a1b2", "...", "\n\n", "   ", "\t", "x" * 40, "'s", "1234567", "é", "\u00a0"]
    mixed = ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(n)) for n in (3, 50, 400, 3000)]
    return [None, "", " ", *mixed, "a" * 5000, " " * 3000, ("word " * 900) + " " * 500 + "tail"]


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1024), (200, 60), (64, 32)])
def test_encoding_is_that_of_the_library(spark, chunk, overlap):
    codec = bpe.Codec(bpe.load_ranks(PATH), PATTERN)
    rows = [(i, t, b"x") for i, t in enumerate(texts())] + [(0, "again", b"x"), (None, "no key " * 100, b"x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids binary")
    got = bpe.encode_documents(docs, PATH, PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, codec.encode(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_long_texts_are_cut_into_chunks_of_the_default_size(spark):
    codec = bpe.Codec(bpe.load_ranks(PATH), PATTERN)
    words = ["alpha ", "naïve", "日本", "😀", "\n", " 12", "don't "]
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(words, k=n))) for i, n in enumerate((12_000, 90_000, 400_000))] + [(7, "a" * 70_000)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, PATTERN).collect()}
    assert all(list(got[i]["ids"]) == codec.encode(t) and bytes(got[i]["decoded"]) == t.encode() for i, t in rows)


def test_encoding_of_an_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH, PATTERN).count() == 0


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.34:
            out[at] = rng.choice("qxz")
        elif kind < 0.67:
            out.insert(at, rng.choice("qxz"))
        else:
            del out[at]
    return "".join(out)


def edit_distance_inside(item, text):
    """Edits of the cheapest occurrence of ``item`` in ``text``."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdefghij      "
    items = ["".join(rng.choices(letters, k=rng.randint(60, 200))).strip() for _ in range(6)]
    table = decontaminate.fold_table()
    normal = lambda t: "".join(map(chr, decontaminate.strip_blanks(decontaminate.normalise(t, table)[0])))
    plain = [normal(i) for i in items]
    docs = []
    for i in range(60):
        filler = "".join(rng.choices(letters, k=300))
        hidden = edited(rng, items[i % 6], rng.choice([0, 1, 2, 3, 5, 8, 12, 30]))
        docs.append((i, filler[:150] + " " + (hidden.upper() if i % 3 == 0 else hidden.replace(" ", " - ")) + " " + filler[150:]))
    frame = spark.createDataFrame([(*d, 1) for d in docs] + [(90, None, 1), (91, "", 1), (92, "ab " * 50_000, 1)], "doc_id bigint, text string, found int")
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, "tiny"), (52, "")], "item_id bigint, text string")
    got = {r["doc_id"]: {m["item_id"]: m for m in r["contamination"]} for r in decontaminate.find_contamination(frame, benchmark).collect()}
    parts = decontaminate.find_contamination(frame, benchmark, part_chars=150)
    assert {r["doc_id"]: {m["item_id"] for m in r["contamination"]} for r in parts.collect()} == {d: set(m) for d, m in got.items()}
    for i, text in docs:
        body = normal(text)
        for k, item in enumerate(plain):
            budget = min(int(decontaminate.EDIT_RATE * len(item)), (len(item) - decontaminate.Q) // decontaminate.Q)
            edits = edit_distance_inside(item, body) if k == i % 6 else 99
            assert (k in got[i]) == (edits <= budget), (i, k, edits, budget)
            if k in got[i]:
                assert got[i][k]["edits"] == edits
    assert not got[90] and not got[91] and not got[92]
    assert all(not r["contamination"] for r in decontaminate.find_contamination(frame, benchmark.limit(0)).collect())


def test_parts_of_items_and_replaced_words_are_found(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 7))) for _ in range(3000)]
    item = rng.choices(words, k=59)
    short = rng.choices(words, k=37)
    filler = lambda: rng.choices(words, k=80)
    replaced = ["zzzz" if i in (5, 17, 30) else w for i, w in enumerate(short)]
    parts = [item, item[:50], item[9:], item[5:55], item[:38], replaced]
    docs = [(i, " ".join([*filler(), *part, *filler()])) for i, part in enumerate(parts)]
    docs += [(20 + i, " ".join([*filler(), *filler()])) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string")
    got = {r["doc_id"]: r["contamination"] for r in decontaminate.find_contamination(frame, benchmark).collect()}
    assert {i: [m["item_id"] for m in got[i]] for i in got} == {**{i: [1] for i in range(5)}, 5: [2], **{20 + i: [] for i in range(5)}}
    assert got[0][0]["edits"] == 0 and docs[0][1][got[0][0]["start"] : got[0][0]["end"]] == " ".join(item)


def test_slices_of_a_text_change_nothing(monkeypatch):
    rng = random.Random(3)
    table = decontaminate.fold_table()
    plain = lambda t: decontaminate.strip_blanks(decontaminate.normalise(t, table)[0])
    items = [plain("".join(rng.choices("abcde ", k=k))) for k in (30, 150, 420)] + [plain("la " * 120)]
    index = decontaminate.Index(list(range(4)), items, decontaminate.Q, decontaminate.EDIT_RATE)
    body = ["".join(map(chr, i)) for i in items]
    texts = [plain(f"{'ab ' * 40}{edited(rng, body[k % 4], k % 3)}{'la ' * 50}{body[2][60:330]} end") for k in range(12)]
    want = [index.find(t) for t in texts]
    assert all(want)
    for chars, postings in ((100, 50), (31, 1)):
        monkeypatch.setattr(decontaminate, "BATCH_CHARS", chars)
        monkeypatch.setattr(decontaminate, "BATCH_POSTINGS", postings)
        assert [index.find(t) for t in texts] == want


def test_memory_of_a_text_that_repeats_itself():
    table = decontaminate.fold_table()
    index = decontaminate.Index([1], [decontaminate.normalise("la " * 119 + "la", table)[0]], decontaminate.Q, decontaminate.EDIT_RATE)
    codes = decontaminate.normalise("la " * 20_000, table)[0]
    tracemalloc.start()
    assert index.find(codes) == [(0, 0, 359, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_columns_of_the_search_and_items_without_a_key(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    frame = spark.createDataFrame([(1, text, 5, 6)], "doc_id bigint, text string, found_in_part int, Found_In_Part_ int")
    benchmark = spark.createDataFrame([(None, text[:40]), (3, text[10:])], "item_id bigint, text string")
    row = decontaminate.find_contamination(frame, benchmark, out="found").first()
    assert [m["item_id"] for m in row["found"]] == [None, 3] or [m["item_id"] for m in row["found"]] == [3, None]
    assert row[2:4] == (5, 6) and len(row) == 5
