"""Co-occurrence pairs (N8, J2, A9, X14) and pair rankings (L2).

Per article: entities are made distinct per sentence; every unordered pair inside one sentence
counts 1; every pair across a sentence and one of the next ``window`` sentences counts 1 (the same
text on both sides is skipped); counts are summed per article and canonical (sorted) pair.

Plan: one equi-join on (article, sentence) after exploding the sentence offset 0..window on the
left side, so both pair kinds come out of a single shuffle join; the pair key is then made
canonical with least/greatest and counted with a partial (map-side) aggregate. With ``partitions`` every
exchange has that many, so a caller who knows the number of rows bounds what one task holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_SHARES = 16


def distinct_sentence_entities(mentions: DataFrame, article: str = "article_id", sentence: str = "sent_idx",
                               entity: str = "entity") -> DataFrame:
    ents = mentions.select(F.col(article).alias("article_id"), F.col(sentence).alias("sent_idx"),
                           F.trim(F.col(entity)).alias("entity"))
    return ents.filter(F.col("entity") != "").distinct()


def cooccurrence_pairs(mentions: DataFrame, window: int = 1, article: str = "article_id",
                       sentence: str = "sent_idx", entity: str = "entity", partitions: int | None = None) -> DataFrame:
    """-> (article_id, entity_1, entity_2, count) with entity_1 < entity_2."""
    if partitions:  # sorted by sentence once: distinct, and one side of the join, need no exchange after it
        mentions = mentions.select(F.col(article).alias("article_id"), F.col(sentence).alias("sent_idx"), F.col(entity).alias("entity"))
        ents = distinct_sentence_entities(mentions.repartition(partitions, "article_id", "sent_idx"))
    else:
        ents = distinct_sentence_entities(mentions, article, sentence, entity)
    left = ents.select("article_id", F.explode(F.sequence(F.lit(0), F.lit(int(window)))).alias("d"),
                       F.col("sent_idx").alias("l_sent"), F.col("entity").alias("l_ent"))
    left = left.withColumn("sent_idx", F.col("l_sent") + F.col("d"))
    right = ents.select("article_id", "sent_idx", F.col("entity").alias("r_ent"))
    cond = ((F.col("d") == 0) & (F.col("l_ent") < F.col("r_ent"))) | \
           ((F.col("d") > 0) & (F.col("l_ent") != F.col("r_ent")))
    if partitions:
        left = left.repartition(partitions, "article_id", "sent_idx")
    pairs = left.join(right, ["article_id", "sent_idx"]).filter(cond).select(
        "article_id", F.least("l_ent", "r_ent").alias("entity_1"), F.greatest("l_ent", "r_ent").alias("entity_2"))
    if partitions:
        pairs = pairs.repartition(partitions, "article_id", "entity_1", "entity_2")
    return (pairs.groupBy("article_id", "entity_1", "entity_2")
            .agg(F.count(F.lit(1)).alias("count")))


def pair_totals(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Total co-occurrence count and number of articles per canonical pair; with ``partitions`` the articles of a
    pair are first summed in shares, so that a frequent pair is not one task's work."""
    if partitions:
        share = F.pmod(F.hash("article_id"), F.lit(PAIR_SHARES))
        parts = (pairs.withColumn("_share", share).repartition(partitions, "entity_1", "entity_2", "_share")
                 .groupBy("entity_1", "entity_2", "_share").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("_n")))
        return parts.repartition(partitions, "entity_1", "entity_2").groupBy("entity_1", "entity_2").agg(
            F.sum("count").cast("long").alias("total_count"), F.sum("_n").alias("n_articles"))
    return pairs.groupBy("entity_1", "entity_2").agg(
        F.sum("count").cast("long").alias("total_count"),
        F.count(F.lit(1)).alias("n_articles"))


def top_pairs(pairs: DataFrame, k: int = 10, partitions: int | None = None) -> DataFrame:
    """Top-k pairs by total count; ties broken by the pair key (TakeOrderedAndProject)."""
    return pair_totals(pairs, partitions).orderBy(F.desc("total_count"), F.desc("n_articles"), "entity_1", "entity_2").limit(k)
