"""Quality rules, whitening and phrases beside versions in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm import phrases, quality, spectrum, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- quality rules -----------------------------------------------------------------------------


def measures(text):
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def normal(line):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x20\t\x0b\f\r]+", " ", re.sub("[1-9]", "0", lowered)).strip(" ")


def brute_quality(rows, max_documents, one_in):
    holders, texts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host, normal(line)].add(text)
                texts[host].add(text)
    frequent = {k for k, v in holders.items() if len(v) > max_documents and len(v) * one_in > len(texts[k[0]])}
    out = []
    for key, text, host in rows:
        text = text or ""
        m = measures(text)
        lines = text.split("\n")
        removed = [i for i, line in enumerate(lines) if (host, normal(line)) in frequent]
        lost = sum(len(WORD.findall(lines[i])) for i in removed)
        m["base_failed"] = m["n_words"] < 5 or m["n_repeat_words"] * 100 > m["n_words"] * 50
        m["removed"], m["words_left"] = removed, m["n_words"] - lost
        m["clean_text"] = "\n".join(line for i, line in enumerate(lines) if i not in set(removed))
        m["kept"] = not m["base_failed"] and lost * 100 <= m["n_words"] * 50
        out.append((key, m))
    return out


def quality_rows():
    notice = "Copyright  2021 All rights\treserved\r"
    rows = [(i, f"{'w%d ' % i * 3}alpha beta gamma number{i} delta\n{notice if i % 2 else notice.upper().replace('2021', '1999')}\nlast line {i} é😀", "a") for i in range(8)]
    rows += [(100 + i, f"one two three four five six {i}\n{notice}", "b") for i in range(3)]
    rows += [(200, "same text here of six words\n" + notice, "a")] * 5  # copies count once
    rows += [(300 + i, notice + "\n" + notice + f"\ntiny {i}", "a") for i in range(3)]  # depleted
    rows += [(400, None, "a"), (401, "", None), (402, " \n\t\n", None), (403, "\n", "a"), (None, "x y z x y z x y z q", None)]
    rows += [(404, "a b c d e f g a b c " * 2000, "c"), (405, "#*$%&|<> " * 9 + "\x0b\x0c one", "c"), (406, "ab" * 200_000 + " tail of five words now", "c")]
    return rows


def test_quality_rules_against_brute_force(spark):
    rows = quality_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, Kept string, _KEY int")
    out = quality.quality_rules(frame, min_words=5, max_documents=4, one_in=10)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "words_left", "clean_text", "kept_"]
    assert out.columns == [*frame.columns, *made]
    order = lambda r: (str(r[0]), str(sorted(r[1].items())))
    found = sorted(((r["doc_id"], {n.rstrip("_"): r[n] for n in made}) for r in rows_of(out)), key=order)
    assert found == sorted(brute_quality(rows, 4, 10), key=order)
    assert any(m["removed"] for _, m in found) and any(not m["base_failed"] and not m["kept"] for _, m in found)


def test_quality_limit_is_a_share_too(spark):
    frame = spark.createDataFrame([(i, f"common line\nown words {'abcdefghijklmnopqrstuvwxyz'[i]}", None) for i in range(20)], "doc_id int, text string, source string")
    share = [quality.quality_rules(frame, max_documents=3, one_in=n).agg(F.sum(F.size("removed"))).first()[0] for n in (1, 2)]
    assert share == [0, 20]


def test_quality_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_quality_runs_without_python(spark):
    frame = spark.createDataFrame([(1, "a b c", "s")], "doc_id bigint, text string, source string")
    plan = quality.quality_rules(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# --- spectrum and whitening --------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "ties", "rank one", "zero", "indefinite", "diagonal", "close"])
def test_spectrum_against_eigh(kind):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    spectra = {
        "ties": [5.0] * 6 + [1.0] * 24,
        "rank one": [7.0] + [0.0] * 29,
        "zero": [0.0] * 30,
        "indefinite": list(range(-15, 15)),
        "close": [3 + 1e-9 * i for i in range(10)] + [1.0] * 20,
    }
    if kind == "random":
        matrix = np.cov(rng.standard_normal((30, 200)))
    elif kind == "diagonal":
        matrix = np.diag(np.arange(30.0))
    else:
        matrix = basis @ np.diag(spectra[kind]) @ basis.T
        matrix = (matrix + matrix.T) / 2
    values, vectors = spectrum.leading_eigenpairs(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.allclose(values, want, rtol=0, atol=1e-12 * max(1, np.abs(want).max()))
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-10)


def test_counts_follow_inertia():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 20):
        matrix = rng.standard_normal((size, size))
        matrix = matrix + matrix.T
        values = np.linalg.eigvalsh(matrix)
        for shift in (*values[:-1] + np.diff(values) / 2, values[0] - 1, values[-1] + 1):
            assert spectrum.count_above(matrix, shift) == int((values > shift).sum())
    assert spectrum.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def vector_rows():
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]).astype("float32")
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of the rows is one vector
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]
    return rows + [(None, rows[1][1]), (5, rows[5][1])]


def test_whitening_against_numpy(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, whitened string, _grid int").repartition(7)
    model = whitening.fit_whitening(frame)
    out = whitening.whiten(frame, model)
    assert out.columns == [*frame.columns, "whitened_", "deviation"]
    good = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1])]
    grid = np.floor(256 * np.array([np.float32(r[1]) for r in good], float)).astype(int)
    fit = np.unique(grid, axis=0)
    assert model.n == len(fit) and model.sums == fit.sum(axis=0).tolist()
    covariance = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert np.allclose(model.values, values, rtol=1e-12) and np.allclose(model.explained, values / np.trace(covariance), rtol=1e-12)
    assert model.identity_error < 1e-12
    want = (grid - fit.mean(axis=0)) @ vectors / np.sqrt(values)
    spread = ((len(fit) * grid - fit.sum(axis=0)) ** 2).sum(axis=1)
    found = sorted(rows_of(out), key=lambda r: (str(r["vec_id"]), r["deviation"]))
    order = sorted(range(len(good)), key=lambda i: (str(good[i][0]), spread[i]))
    assert [r["deviation"] for r in found] == [spread[i] for i in order]
    signs = np.sign((np.array([r["whitened_"] for r in found]) * want[order]).sum(axis=0))
    assert np.allclose(np.array([r["whitened_"] for r in found]) * signs, want[order], atol=1e-9)


def test_whitening_odd_input(spark):
    schema = "vec_id int, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    model = whitening.fit_whitening(empty)
    assert model.n == 0 and model.rank == 0 and whitening.whiten(empty, model).count() == 0
    same = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(9)], schema)
    model = whitening.fit_whitening(same)
    assert model.n == 1 and model.rank == 0 and [r["whitened"] for r in rows_of(whitening.whiten(same, model))] == [[]] * 9
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)
    assert whitening.fit_whitening(flat).rank == 1
    with pytest.raises(ValueError, match="entries"):
        whitening.fit_whitening(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_deviation_is_exact_beyond_doubles(spark):
    frame = spark.createDataFrame([(1, [1e6, 0.0]), (2, [-1e6, 1 / 256]), (3, [3.0, 5.0])], "vec_id int, embedding array<double>")
    model = whitening.fit_whitening(frame)
    grid = [[256_000_000, 0], [-256_000_000, 1], [768, 1280]]
    want = [sum((3 * v - s) ** 2 for v, s in zip(x, model.sums)) for x in grid]
    assert [r["deviation"] for r in sorted(rows_of(whitening.whiten(frame, model)), key=lambda r: r["vec_id"])] == want


# --- phrases -----------------------------------------------------------------------------------


def brute_phrases(rows, least, top, longest=5):
    totals, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        often = {w: c for w, c in found.items() if c >= least}
        best = {}
        for w, a in often.items():
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        best[w[i:j]] = max(best.get(w[i:j], 0), a)
        scored = []
        for w, a in often.items():
            if len(w) > 1 and not 100 * best.get(w, 0) >= 100 * a:
                score, k = min((1000 * a * totals[lang] // (often[w[:k]] * often[w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), often[w[:k]], often[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(11)
    vocabulary = np.array("the of New york city é😀 a\x01 a \x00 b! San".split(" "))
    weights = np.arange(len(vocabulary), 0, -1) / np.arange(1, len(vocabulary) + 1).sum()
    rows = []
    for i in range(120):
        words = rng.choice(vocabulary, size=int(rng.integers(0, 60)), p=weights)
        rows.append((" ".join(words) + (". New York city hall\tis  open\nNEW york" if i % 2 else ""), ["en", "de", None, "und"][i % 4]))
    rows += [("ha " * 4000, "en"), (None, "en"), ("", None), ("..;\n\n", "fr"), ("one", "fr")]
    return rows + [("deep learning rocks now and here", "en")] * 40


@pytest.mark.parametrize("flush, bits, partitions", [(1 << 20, 24, 1), (50, 6, 13)])
def test_phrases_against_brute_force(spark, monkeypatch, flush, bits, partitions):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "FLUSH_WORDS", flush)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 7 * flush)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, words int").repartition(partitions)
    changed = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        scored = phrases.collocations(frame, phrases.Settings(min_count=7, filter_bits=bits))
        for top in (5, 2000):
            ranked = phrases.top_phrases(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
            assert sorted(map(tuple, ranked.collect())) == brute_phrases(rows, 7, top)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_phrases_windows_are_added_up_by_task(spark, monkeypatch):
    """Neither more partitions of the input nor more parts of a task give more rows of a phrase."""
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 20)
    cores = spark.sparkContext.defaultParallelism
    frame = spark.createDataFrame([("en", f"the city hall is open now. only{i}") for i in range(40 * cores)], "lang string, text string").repartition(10 * cores)
    windows = phrases.windows(frame, phrases.Settings(min_count=100, filter_bits=16)).collect()
    sums = Counter()
    for row in windows:
        sums[tuple(row.words)] += row.a
    text = "the city hall is open now".split()
    assert sums == {(): 7 * 40 * cores, **{tuple(text[i : i + 5]): 40 * cores for i in range(6)}}
    assert len(windows) <= 7 * cores


def test_phrases_windows_beyond_what_a_task_holds(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 50)
    monkeypatch.setattr(phrases, "SUMS_BYTES", 2000)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    ranked = phrases.top_phrases(phrases.collocations(frame, phrases.Settings(min_count=7, filter_bits=12)), 2000)
    assert sorted(map(tuple, ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(rows, 7, 2000)


def test_phrases_empty_table(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.top_phrases(phrases.collocations(empty), 10).count() == 0


def test_phrases_exact_beyond_64_bits(spark):
    from unittest import mock

    big = 3 * 10**15
    counts = [([], 10 * big), (["x"], big + 1), (["y"], big), (["x", "y"], big - 1)]
    frame = spark.createDataFrame([("en", w, a) for w, a in counts], "lang string, words array<string>, a bigint")
    with mock.patch.object(phrases, "phrase_counts", lambda *_: frame):
        row = phrases.collocations(frame).first()
    assert row["score"] == 1000 * (big - 1) * 10 * big // ((big + 1) * big)


# --- the registered queries --------------------------------------------------------------------

SF_DIR = "/root/testdata/sf0.001"
LONG = "bigint"
TYPES = {
    "op11_quality_rules": {
        **dict.fromkeys(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], LONG),
        "base_failed": "boolean",
        "kept": "boolean",
    },
    "op12_embedding_whitening": {
        **dict.fromkeys(["vec_id", "n", "deviation"], LONG),
        "component": "int",
        **dict.fromkeys(["whitened", "explained", "identity_error"], "double"),
    },
    "op13_phrase_collocations": {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], LONG)},
}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_queries_return_the_agreed_columns(spark, name):
    from ballast.llm.queries import QUERIES

    found = QUERIES[name](spark, SF_DIR)
    assert dict(found.dtypes) == TYPES[name]
    if name == "op12_embedding_whitening":
        rows = found.collect()
        vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
        assert len(rows) == 4 * vectors and {r["component"] for r in rows} == {1, 2, 3, 4}
        assert {r["identity_error"] < 1e-4 for r in rows} == {True}
        assert len({(r["component"], r["explained"]) for r in rows}) == 4
