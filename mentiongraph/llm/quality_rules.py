"""Quality rules by distribution divergence, with DataFrame functions only.

A document's character-class histogram and the histogram of its language's most common words are
compared with references by Jensen-Shannon distance (base 2, 0 to 1). The reference of a language is
the mean histogram of all its documents that pass the base rules, so it follows the whole table.
So does the limit of the word distance: a share of the distance from the language's reference to a
text without any common word.
Texts shorter than ``min_chars`` and languages with fewer than ``min_reference`` documents get no
verdict from the distances. The features are read from the texts once and written as a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

# Frequent words by language code.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "are", "from", "with", "was", "as", "on", "or"],
    "de": ["der", "die", "und", "das", "nicht", "mit", "sich", "von", "zu", "im", "den", "ist", "ein", "in", "auf", "für"],
    "fr": ["le", "la", "de", "et", "les", "des", "que", "dans", "une", "un", "en", "pour", "est", "du", "au", "il"],
    "es": ["el", "la", "de", "que", "y", "los", "del", "las", "con", "por", "una", "un", "en", "su", "no", "al"],
}
# Character classes; what no class holds is the last bin.
CHAR_CLASSES = ["aeiou", "b-df-hj-np-tv-z", "A-Z", "0-9", r" \t\n\x0B\f\r", r".,;:!?'\"()", r"#*$%&|<>/\\=+_@\[\]{}~^`-", r"À-ɏ"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_word_count(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: equal windows are neighbours once sorted by hash."""
    n = F.size(words)
    hashed = F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(hashed, places), cover)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to 1 (0 if either is missing)."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: 0.5 * (part(x, (x + y) / 2) + part(y, (x + y) / 2)))
    return F.sqrt(F.greatest(F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), F.lit(0.0)))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, words) per row."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang") if "lang" in docs.columns else F.lit("").alias("lang"))
    n_chars = F.char_length("text").cast("long")
    lists = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in COMMON_WORDS.items() for x in kv))
    none = F.array().cast("array<string>")

    def without(chars: str) -> Column:
        return n_chars - F.char_length(F.regexp_replace("text", f"[{chars}]+", "")).cast("long")

    def from_words(w: Column) -> Column:
        wanted = F.coalesce(F.try_element_at(lists, F.col("lang")), none)

        def bins(common: Column) -> Column:
            return F.concat(F.transform(wanted, lambda c: F.size(F.filter(common, lambda x: x == c)).cast("double")),
                            F.array((F.size(w) - F.size(common)).cast("double")))

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_word_count(w).alias("n_repeat_words"),
            let(F.filter(w, lambda x: F.array_contains(wanted, x)), bins).alias("words"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    classes = F.array(*(without(c).cast("double") for c in CHAR_CLASSES))
    return base.select(
        "doc_id", "lang", n_chars.alias("n_chars"), let(words_of(F.col("text")), from_words).alias("w"),
        without("#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(classes, lambda c: F.concat(c, F.array(n_chars - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))).alias("chars"),
    ).select("doc_id", "lang", "n_chars", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "chars", "w.words")


def _share(histogram: str) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(histogram, lambda x: x / total))


def _means(column: str, size: int) -> Column:
    return F.array(*(F.avg(F.get(column, F.lit(i))) for i in range(size)))


def _no_common_word(reference: str) -> Column:
    """Distance of a mean histogram to that of a text whose words all lie in the last bin."""
    mean = F.filter(reference, lambda x: x.isNotNull())  # bins beyond a language's list are null
    return js_distance(mean, F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.size(mean) - 1, F.lit(0))), F.array(F.lit(1.0))))


def judge(docs: DataFrame, max_char_distance: float = 0.3, max_word_distance: float = 0.45, min_chars: int = 300,
          min_reference: int = 30, max_word_share: float = 0.85) -> DataFrame:
    """Per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed and both distances within their limits, where a distance is defined; the word distance also within
    ``max_word_share`` of what a text without common words has. Null text has no
    words and fails; null doc_id passes through; null or unknown languages share one reference (and
    have no common words); repeated rows each give a row; an empty table gives an empty result; further
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    known = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(""))
    table = scratch.write("features", features(docs).withColumn("lang", known)
                          .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    shares = table.withColumns({"p": _share("chars"), "q": _share("words")})
    most = 1 + max(map(len, COMMON_WORDS.values()))
    # five rows at most: the language codes above and one for all others
    reference = shares.where(~F.col("base_failed") & (F.col("n_chars") >= min_chars)).groupBy("lang").agg(
        F.count("*").alias("reference_docs"), _means("p", len(CHAR_CLASSES) + 1).alias("rp"), _means("q", most).alias("rq")).withColumn("none", _no_common_word("rq"))
    enough = (F.col("n_chars") >= min_chars) & (F.coalesce("reference_docs", F.lit(0)) >= min_reference)
    joined = shares.join(F.broadcast(reference), "lang", "left")
    # a null bin beyond a language's list adds nothing
    near = F.slice("rq", F.lit(1), F.greatest(F.size("q"), F.lit(0)))
    judged = joined.withColumns({"char_distance": F.when(enough, js_distance(F.col("p"), F.col("rp"))),
                                 "word_distance": F.when(enough, js_distance(F.col("q"), near))})
    limit = F.least(F.lit(max_word_distance), F.lit(max_word_share) * F.col("none"))
    fine = F.coalesce(F.col("char_distance") <= max_char_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= limit, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
                         (~F.col("base_failed") & fine).alias("kept"))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that :func:`judge` keeps; a row goes by the verdict on its doc_id's rows (any of them kept).

    Rows with null doc_id go only if every such row fails."""
    verdict = judge(docs, **rules).where("kept").select("doc_id").distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["doc_id"]), "left_semi")
