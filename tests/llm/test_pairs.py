"""MinHash near-duplicates, embeddings and components against brute force."""

import random

import numpy as np
import pytest

from ballast.llm import embeddings, minhash
from ballast.llm.components import connected_components


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def word_shingles(text, words):
    parts = [w for w in (text or "").encode().lower().split()]
    if not parts:
        return frozenset()
    return frozenset([tuple(parts)]) if len(parts) < words else frozenset(tuple(parts[i : i + words]) for i in range(len(parts) - words + 1))


def near_copies(rng, count, words, base_words=60):
    base = [rng.choice(words) for _ in range(base_words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # all long lists go through several cells
        monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
        monkeypatch.setattr(minhash, "SHORT_LIST", 2)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = near_copies(rng, 60, words) + near_copies(rng, 12, words, 8) + near_copies(rng, 20, words, 200)
    texts += [" ".join(rng.choices(words, k=50)) for _ in range(40)] + ["A b", "a B", "c", "", None, None, "x " * 3000, "\x0b\x1fz"] + texts[:5]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "a b", "x")], "doc_id bigint, text string, id string")
    settings = minhash.Settings(3, (85, 100))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, settings).collect()}
    sets = {i: word_shingles(t, 3) for i, t, _ in rows}

    def linked(a, b):
        shared = len(sets[a] & sets[b])
        return shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared)

    want = brute_components(list(sets), linked)
    assert {i: got[i]["component_id"] for i in sets} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_repeated_keys_join_their_texts(spark):
    rows = [(5, "a b c d e"), (5, "f g h i j"), (7, "a b c d e"), (3, "f g h i j"), (3, "f g h i j")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.Settings(3, (85, 100))).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {3}
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 300)] + [(9, 9), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 200 for i in range(201, 300)}}


def brute_links(rows, cosine):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    def linked(a, b):
        (_, v, k), (_, w, m) = rows[a], rows[b]
        if k is None or k != m or not good(v) or not good(w) or len(v) != len(w):
            return False
        return float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= cosine

    n = len(rows)
    degree = [sum(linked(a, b) for b in range(n) if b != a) for a in range(n)]
    return degree, brute_components(list(range(n)), linked)


@pytest.mark.parametrize("block_rows", [5, 512])
def test_embeddings_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = []
    for centre in range(8):
        base = rng.normal(size=24)
        rows += [(base + rng.normal(size=24) * 0.05, centre % 2) for _ in range(25)]
    rows += [(rng.normal(size=24), 0) for _ in range(60)]
    rows = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(rows)]
    n = len(rows)
    odd = [(None, 0), ([0.0] * 24, 0), ([float("nan")] * 24, 0), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([], 1), (rows[0][1], None), (rows[0][1][:5], 0)]
    rows += [(n + i, v, k) for i, (v, k) in enumerate(odd)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, row string")
    got = {r["vec_id"]: r for r in embeddings.link_embeddings(frame, block_rows=block_rows).collect()}
    degree, component = brute_links(rows, 0.93)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert 0.9 * sum(degree) <= found <= sum(degree) and all(got[i]["n_links"] <= degree[i] for i in range(len(rows)))
    exact = [i for i in range(len(rows)) if got[i]["component_id"] == component[i]]
    assert len(exact) >= 0.98 * len(rows) and all(got[i]["n_links"] == 0 for i in range(n, len(rows)))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))
    assert embeddings.link_embeddings(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "common"), [(64, 0.0), (64, 0.7), (256, 0.0)])
def test_recall_of_pairs_planted_at_the_threshold(spark, size, common):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    direction = unit(rng.normal(size=size))
    base = np.sqrt(common) * direction + np.sqrt(1 - common) * unit(rng.normal(size=(900, size)))
    base = unit(base)
    own = base[:300]
    away = rng.normal(size=own.shape)
    away = unit(away - (away * own).sum(1, keepdims=True) * own)
    cosine = rng.uniform(0.931, 0.95, (300, 1))
    partner = cosine * own + np.sqrt(1 - cosine**2) * away
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, partner]))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.link_embeddings(frame).collect()}
    found = [got[900 + i]["component_id"] == got[i]["component_id"] for i in range(300)]
    assert sum(found) >= 0.94 * len(found)
