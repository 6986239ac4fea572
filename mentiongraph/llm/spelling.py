"""Spelling variant grouping: words one edit apart found by asymmetric q-chunks.

Of two words one edit apart, the shorter (either, at equal lengths) contributes disjoint chunks, the
other the grams at the places where these chunks can stand: unmoved left of the edit, moved by the
difference of the lengths (at most one) right of it. Two chunks, the halves of a word, are enough for one of
them to be whole. A half is shared by too many words of a large vocabulary to pair all of them, so the half in doubt is
cut again by the same argument until the part in doubt has ``CHUNK`` code points (an eighth of longer words).
What two partners must share is then everything before one chunk and everything after it. Words meet in a join on that key,
whose groups are bounded by what can be written in the part in doubt, not by the table, and every pair is verified.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent; forms then grow at least by this factor
from step to step, so chains of forms are short, and a word's root is found by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, text_groups
from .tables import Scratch

RUN = re.compile("[a-zÀ-ÿ]+")
CHUNK, MOST_CHUNKS = 3, 8
HELD_WORDS = 200_000


# ------------------------------------------------------------------ words


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, change: Callable[[str, int], str] | None = None) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``least`` times in the table.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z lower-cased. ``change(word, h)``, h being the crc32 of
    ``<doc_id>:<word>``, may replace the occurrences of a word in a document. Null and empty texts have no words; rows of
    null doc_id are read with the id ``null``; repeated rows count again.
    """
    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, _, texts in text_groups(batch):
                for k, text in enumerate(texts):
                    name = "null" if ids[first + k] is None else str(ids[first + k])
                    start = zlib.crc32(f"{name}:".encode())
                    for word, n in Counter(RUN.findall(text.lower().decode())).items():  # lower() of bytes: A-Z only
                        if change is not None:
                            word = change(word, zlib.crc32(word.encode(), start))
                        if len(word) >= shortest:
                            held[word] = held.get(word, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield _rows(held)
                        held = {}
        if held:
            yield _rows(held)

    found = map_arrow(id_text(docs), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _rows(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def dropped_letter(word: str, h: int) -> str:
    """A misspelling planted in one of 31 (document, word) pairs: one code point left out."""
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


# ------------------------------------------------------------------ near words


def _keys(length: Column, moved: int) -> Column:
    """Keys (64-bit hashes) of ``word`` as partner of a word of ``length`` code points, which is ``moved`` shorter than it.

    Chunk j of the shorter word is its places [size * j, size * (j + 1)); the key holds what lies before it and, ``moved`` further on, after it.
    """
    size = F.greatest(F.lit(CHUNK), F.ceil(length / MOST_CHUNKS)).cast("int")
    last = F.floor((length - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.xxhash64(
        length, j, F.substring(F.col("word"), F.lit(1), j * size),
        F.substring(F.col("word"), (j + 1) * size + 1 + moved, F.greatest(length - (j + 1) * size, F.lit(0)))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of words one inserted, deleted or replaced code point apart, in one of both directions.

    ``words`` are distinct (word, n) rows. A pair that meets under several keys comes several times.
    """
    length = F.char_length("word")
    chunks = words.select("word", "n", F.explode(_keys(length, 0)).alias("key"))
    grams = words.select("word", "n", F.explode(F.concat(
        F.transform(_keys(length, 0), lambda k: F.struct(k.alias("key"), F.lit(0).alias("moved"))),
        F.transform(_keys(length - 1, 1), lambda k: F.struct(k.alias("key"), F.lit(1).alias("moved"))))).alias("g")) \
        .select(F.col("word").alias("b"), F.col("n").alias("b_n"), "g.key", "g.moved")
    return chunks.join(grams, "key").where("moved = 1 or word < b").where(F.levenshtein("word", "b", 1) == 1) \
        .select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")


def variants(words: DataFrame, ratio: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of the distinct (word, n) rows ``words``.

    Ties between near words of one frequency go to the smallest in code-point order. A word without near words, or whose
    most frequent one is not ``ratio`` times as frequent, has null form and form_n and is its own root. An empty table
    gives an empty result.
    """
    scratch = scratch or Scratch(words.sparkSession)
    words = scratch.write("words", words.select("word", F.col("n").cast("long").alias("n")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    # dealt by word once: this serves the distinct pairs, the choice among them and the join with the words
    dealt = near_pairs(words).select(ends.alias("e")).select("e.*").repartition("word")
    best = dealt.groupBy("word", "near").agg(F.max("near_n").alias("near_n")).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    takes = -F.col("best.rank") >= ratio * F.col("n")
    rows = scratch.write("forms", rows.select(
        "word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.rank")).alias("form_n")))
    steps = scratch.write("steps", rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = scratch.write("steps-next", steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                                    F.col("further").isNotNull().alias("moved")))
        done = jumped.where("moved").isEmpty()
        steps = scratch.write("steps", jumped.select("word", "root"))
        if done:
            break
    scratch.drop("words", "steps-next")
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
