"""Quality rules: counts inside each text, and lines that recur across the documents of a host.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted.
Lines above the limits are boilerplate and removed; a document that loses most of its words with
them is rejected. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.columns import ascii_lower, fresh, stored

BLANKS = "\t\n\x0b\x0c\r "  # what separates words
SYMBOLS = "#*$%&|<>"
WINDOW = 3  # words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds at least twice.

    Windows are compared by 64-bit hashes; sorted with their positions, equal ones are neighbours.
    """

    def windows(h: Column) -> Column:
        full = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return F.slice(full, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twice = let(
            placed,
            lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i + 1)["h"]) | (x["h"] == F.get(p, i - 1)["h"])),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

        def add(state: Column, at: Column) -> Column:
            end = at + WINDOW
            return F.struct(end.alias("end"), (state["total"] + end - F.greatest(state["end"], at)).alias("total"))

        return F.aggregate(starts, nothing, add, lambda state: state["total"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))


def text_measures(text: Column) -> dict[str, Column]:
    """The counts of one text (not NULL)."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    words = words_of(text)
    return {
        "n_words": F.size(words),
        "word_chars": length_without(text, BLANKS),
        "n_symbols": F.length(text) - length_without(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
    }


def normalised_lines(text: Column) -> Column:
    """Every line of a text: A-Z in lower case, digits as 0, blanks as single spaces, trimmed."""
    plain = F.translate(ascii_lower(text), "123456789", "0" * 9)
    plain = F.regexp_replace(plain, "[\\x20\\t\\x0b\\f\\r]+", " ")
    return F.transform(F.split(plain, "\n"), lambda line: F.trim(line))


def text_key(host: Column, text: Column) -> Column:
    """What identifies a text of a host: 128 bits of hash, and 64 of the host."""
    owner = F.xxhash64(F.coalesce(host, F.lit("")), host.isNull())
    return F.struct(owner.alias("host"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def frequent_lines(lines: DataFrame, max_documents: int, one_in: int) -> DataFrame:
    """``(host, line)`` found in more distinct texts of the host than both limits allow."""
    texts = lines.select("host", "k1", "k2").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    found = lines.select("host", "line", "k1", "k2").distinct().groupBy("host", "line").agg(F.count("*").alias("found"))
    found = found.where(F.col("found") > max_documents)
    # One row for each host beside few lines: adaptive execution picks the join by measured size.
    return found.join(texts, "host").where(F.col("found") * one_in > F.col("texts")).select("host", "line")


def quality_rules(
    documents: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_documents: int = 10,
    one_in: int = 2000,
    max_removed_percent: int = 50,
) -> DataFrame:
    """``documents`` with the counts of ``text_measures`` and these columns (taken names get a suffix):

    ``base_failed`` (under ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated
    windows); ``removed`` (positions from 0 of lines found in more than ``max_documents`` distinct texts of
    the host and in more than one of ``one_in`` of its texts); ``words_left``; ``clean_text`` (the lines that
    stay); and ``kept``: not failed, and not more than ``max_removed_percent`` of its words removed.

    A document is a distinct text of a host, so copies and repeated rows count once. NULL is a host of its
    own. NULL and empty texts have no words and fail; an empty table gives an empty one.
    """
    body, key, base = (fresh(documents, name) for name in ("_body", "_key", "_base"))
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.withColumn(body, content).withColumn(key, text_key(F.col(f"`{host}`").cast("string"), F.col(body)))

    cut = F.posexplode(normalised_lines(F.col(body)))
    lines = rows.select(F.col(f"{key}.*"), cut.alias("pos", "value")).where(F.col("value") != "")
    lines = lines.select("host", "k1", "k2", "pos", F.xxhash64("value").alias("line"), F.size(words_of(F.col("value"))).alias("words"))
    lines = stored(lines.distinct(), "lines")
    removed = lines.join(frequent_lines(lines, max_documents, one_in), ["host", "line"])
    removed = removed.groupBy("host", "k1", "k2").agg(F.sort_array(F.collect_list("pos")).alias("removed"), F.sum("words").alias("lost"))
    # Written, so that its size is known: small ones are broadcast, others meet the texts by a sort-merge join.
    removed = stored(removed.select(F.struct("host", "k1", "k2").alias(key), F.struct("removed", "lost").alias("_gone")), "removed")

    measures = F.struct(*[m.cast("bigint").alias(n) for n, m in text_measures(F.col(body)).items()])
    own = [F.col(f"`{c}`") for c in documents.columns]
    rows = rows.select(*own, body, key, measures.alias(base))
    joined = rows.alias("rows").join(removed.alias("removed"), F.col(f"rows.{key}") == F.col(f"removed.{key}"), "left")
    joined = joined.select(*[F.col(f"rows.`{c}`") for c in documents.columns], f"rows.{body}", f"rows.{base}", "removed._gone")
    none = F.array().cast("array<int>")
    gone, lost = F.coalesce(F.col("_gone.removed"), none), F.coalesce(F.col("_gone.lost"), F.lit(0).cast("bigint"))
    measured = F.col(base)
    failed = (measured["n_words"] < min_words) | (measured["n_repeat_words"] * 100 > measured["n_words"] * max_repeat_percent)
    depleted = lost * 100 > measured["n_words"] * max_removed_percent
    cleaned = let(
        F.split(F.col(body), "\n"),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"),
    )
    made = {
        **{n: measured[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
        "base_failed": failed,
        "removed": gone,
        "words_left": measured["n_words"] - lost,
        "clean_text": F.when(F.size(gone) == 0, F.col(body)).otherwise(cleaned),
        "kept": ~failed & ~depleted,
    }
    return joined.select(*own, *[column.alias(fresh(documents, name)) for name, column in made.items()])
