"""Text enrichment (N1-N8, D7, X13) as column expressions over whole texts.

* ``sentences`` (N1): the text is cut into consecutive pieces that each end with a run of
  sentence terminators (or the end of the text); a sentence is a piece without its leading
  whitespace. Offsets come from a running sum of piece lengths inside the document.
* ``chunks`` (N2): windows of 8 sentences stepping by 6, one chunk for 8 or fewer sentences,
  stopping at the chunk that reaches the last sentence.
* ``mention_spans`` (N3, N4, J3, D7): chunk texts are put together from their sentences, the built-in
  extractor (a capitalised-token rule; ``extract_with`` plugs in a model through ``mapInPandas``) runs on each
  chunk, offsets are shifted to the text, what overlapping chunks find twice is kept once, and a mention
  goes to the sentence that holds its start, by one ordered pass over sentence starts and mention starts.
* ``mentions``: the same rule run per sentence where offsets are not needed.
* ``sentence_scores`` (N5, N6, N7): distinct sentences with a mention are scored once, on their first
  512 characters; the built-in scorer is a lexicon count in SQL; the signed score is +confidence for
  a positive label, -confidence for a negative one, else 0.
* ``html_text`` (X13, F18): script/style/nav/comments/tables removed, tags stripped, entities
  unescaped, whitespace collapsed; texts shorter than 50 characters fall back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intake import MIN_CONTENT_LENGTH, strip_ws

# Fixed values.
PIECE_PATTERN = r"[^.!?]*[.!?]+|[^.!?]+\z"
CAPITALISED_TOKEN = r"\p{Lu}\p{Ll}+"
MARKS = "\x01\x02"  # read as spaces where they occur in a text
CHUNK_SENTENCES = 8
CHUNK_OVERLAP = 2
SENTIMENT_MAX_CHARS = 512
# Built-in lexicon of the default scorer (ours; the model-based scorer plugs in instead).
POSITIVE_WORDS = ["good", "great", "win", "wins", "success", "hope", "peace", "support", "strong", "gut", "bien", "bueno"]
NEGATIVE_WORDS = ["bad", "crisis", "war", "loss", "fail", "fear", "attack", "weak", "scandal", "schlecht", "mal", "malo"]


def _pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_idx, char_start, char_end, sentence, piece): the piece is the sentence with the white space before it."""
    pieces = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECE_PATTERN), 0)).alias("pos", "piece"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^[ \t\n\r\f]+", ""))
    s = (pieces.withColumn("sentence", F.regexp_replace("piece", r"^[ \t\n\r\f]+", ""))
         .filter(strip_ws(F.col("sentence")) != "")
         .withColumn("char_start", (F.col("_off") + lead).cast("int"))
         .withColumn("char_end", (F.col("_off") + F.length("piece")).cast("int")))
    w2 = Window.partitionBy(key).orderBy("pos")
    return s.select(key, (F.row_number().over(w2) - 1).alias("sent_idx"), "char_start", "char_end", "sentence", "piece")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """N1 -> (key, sent_idx, char_start, char_end, sentence)."""
    return _pieces(docs, key, text).drop("piece")


def chunks(sents: DataFrame, key: str = "doc_id", size: int = CHUNK_SENTENCES, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """N2 -> (key, chunk_idx, start_sentence, end_sentence, char_start, char_end)."""
    step = max(1, size - overlap)
    per_doc = sents.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    starts = per_doc.select(key, "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))).alias("chunk_idx", "start_sentence"))
    starts = starts.filter((F.col("chunk_idx") == 0) | (F.col("start_sentence") - step + size - 1 < F.col("_n") - 1))
    ch = starts.withColumn("end_sentence", F.least(F.col("_n") - 1, F.col("start_sentence") + size - 1))
    bounds = sents.select(key, "sent_idx", "char_start", "char_end")
    ch = (ch.join(bounds.select(key, F.col("sent_idx").alias("start_sentence"), "char_start"), [key, "start_sentence"])
            .join(bounds.select(key, F.col("sent_idx").alias("end_sentence"), "char_end"), [key, "end_sentence"]))
    return ch.select(key, "chunk_idx", "start_sentence", "end_sentence", "char_start", "char_end")


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SENTENCES, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """N2 with its text -> (key, chunk_idx, char_start, text): sentence by sentence, so a long text is not copied for each chunk."""
    step = max(1, size - overlap)
    per_doc = Window.partitionBy(key)
    rows = _pieces(docs, key, text).withColumn("_n", F.count(F.lit(1)).over(per_doc))
    # the chunks that can hold a sentence start at most size - 1 sentences before it
    k = F.floor(F.col("sent_idx") / step).cast("int")
    rows = rows.withColumn("chunk_idx", F.explode(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // step)), lambda back: k - back)))
    first = F.col("chunk_idx") * step
    rows = rows.filter((F.col("chunk_idx") >= 0) & (F.col("sent_idx") < first + size) & ((F.col("chunk_idx") == 0) | (first - step + size < F.col("_n"))))
    held = rows.groupBy(key, "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "char_start", "sentence", "piece"))).alias("s"))  # size sentences
    return held.select(key, "chunk_idx", F.col("s")[0]["char_start"].alias("char_start"), F.concat(
        F.col("s")[0]["sentence"], F.array_join(F.transform(F.slice("s", F.lit(2), F.lit(size)), lambda x: x["piece"]), "")).alias("text"))


def chunk_mentions(chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """N3 built-in extractor per chunk -> (key, chunk_idx, entity, type, char_start, char_end), offsets in the document."""
    # tokens are marked and the text is split at the marks: each part but the first is a token, a second mark, and what follows
    plain = F.translate("text", MARKS, "  ")
    parts = F.split(F.regexp_replace(plain, f"({CAPITALISED_TOKEN})", f"{MARKS[0]}$1{MARKS[1]}"), MARKS[0])
    m = chunk_rows.select(key, "chunk_idx", F.col("char_start").alias("_c"), F.posexplode(parts).alias("pos", "part"))
    marked = F.when(F.col("pos") > 0, F.lit(1)).otherwise(F.lit(0))
    w = Window.partitionBy(key, "chunk_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("char_start", (F.col("_c") + F.coalesce(F.sum(F.length("part") - marked).over(w), F.lit(0))).cast("int"))
    m = m.filter("pos > 0").withColumn("entity", F.substring_index("part", MARKS[1], 1))
    return m.select(key, "chunk_idx", "entity", F.lit("PROPN").alias("type"), "char_start", (F.col("char_start") + F.length("entity")).alias("char_end"))


def dedupe_mentions(ments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (text, type, start, end) of a document, that of its first chunk."""
    same = [key, "entity", "type", "char_start", "char_end"]
    return ments.groupBy(*same).agg(F.min("chunk_idx").alias("chunk_idx"))


def assign_sentences(ments: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ments`` with sent_idx: the sentence whose [start, end) holds the mention's start, else the document's last.

    Sentence starts and mention starts are put in one order per document; the last start at or before a mention is the
    only sentence that can hold it. A document without sentences gives null.
    """
    s = sents.select(key, F.col("char_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("sent_idx", F.col("char_end").alias("end")).alias("_s"))
    m = ments.select(key, F.col("char_start").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in ments.columns if c != key]).alias("_m"))
    both = s.unionByName(m, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_f", F.last("_s", ignorenulls=True).over(upto)).withColumn("_last", F.max("_s.sent_idx").over(Window.partitionBy(key)))
    inside = F.col("_at") < F.col("_f.end")
    return both.filter("_kind = 1").select(key, "_m.*", F.when(inside, F.col("_f.sent_idx")).otherwise(F.col("_last")).alias("sent_idx"))


def mention_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """N3, D7, N4 over whole texts -> (key, entity, type, char_start, char_end, chunk_idx, sent_idx)."""
    found = dedupe_mentions(chunk_mentions(chunk_texts(docs, key, text), key), key)
    return assign_sentences(found, sentences(docs, key, text).drop("sentence"), key)


def mentions(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """N3/N4/D7 built-in extractor -> (key, sent_idx, entity, type, sentence)."""
    m = sents.select(key, "sent_idx", "sentence",
                     F.explode(F.regexp_extract_all(F.col("sentence"), F.lit(CAPITALISED_TOKEN), 0)).alias("entity"))
    return m.select(key, "sent_idx", "entity", F.lit("PROPN").alias("type"), "sentence")


def extract_with(sents: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """N3 plug point: a pandas batch function (model loaded once per Python worker) over sentences."""
    return sents.mapInPandas(fn, schema)


def _count_in(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: F.array_contains(F.array(*[F.lit(w) for w in words]), t)))


def sentence_scores(ments: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One score per distinct sentence that has a mention -> (key, sent_idx, label, confidence, signed_score)."""
    todo = ments.select(key, "sent_idx").distinct().join(sents.select(key, "sent_idx", "sentence"), [key, "sent_idx"])
    toks = F.regexp_extract_all(F.lower(F.substring("sentence", 1, SENTIMENT_MAX_CHARS)), F.lit(r"\p{L}+"), 0)
    scored = (todo.withColumn("_p", _count_in(toks, POSITIVE_WORDS)).withColumn("_n", _count_in(toks, NEGATIVE_WORDS)))
    label = (F.when(F.col("_p") > F.col("_n"), F.lit("POSITIVE")).when(F.col("_n") > F.col("_p"), F.lit("NEGATIVE"))
             .otherwise(F.lit("NEUTRAL")))
    conf = (F.abs(F.col("_p") - F.col("_n")) + 1.0) / (F.col("_p") + F.col("_n") + 2.0)
    scored = scored.withColumn("label", label).withColumn("confidence", conf)
    return scored.select(key, "sent_idx", "label", "confidence", signed_score(F.col("label"), F.col("confidence")).alias("signed_score"))


def signed_score(label: Column, confidence: Column) -> Column:
    """+confidence when the label contains POS, -confidence when it contains NEG, else 0."""
    up = F.upper(label)
    return (F.when(F.instr(up, "POS") > 0, confidence).when(F.instr(up, "NEG") > 0, -confidence)
            .otherwise(F.lit(0.0)))


def attach_scores(ments: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Score and confidence per mention, (0, 0) when the sentence has none."""
    return (ments.join(scores.select(key, "sent_idx", "signed_score", "confidence"), [key, "sent_idx"], "left")
            .withColumn("sentiment_score", F.coalesce("signed_score", F.lit(0.0)))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("signed_score"))


def html_text(html: Column, fallback: Column, min_len: int = MIN_CONTENT_LENGTH) -> Column:
    """X13 + F18: main text of an HTML page, or the fallback when under ``min_len`` characters."""
    t = html
    for tag in ("script", "style", "nav", "table", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = strip_ws(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(t) >= min_len, t).otherwise(fallback)
