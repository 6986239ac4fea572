"""Three-stage correlation by article id (J6, A13) in batch form, and an article's progress through the stages.

raw article -> enriched result within ``timeout_s`` -> change event within ``timeout_s`` of the
enriched result. Each hop is an equi-join on the article id with a time-range condition, of which the
first match in time counts; a missing right side is reported as a timeout at that step. The streaming form, with
event-time timers, is ``streaming.pipelines.correlate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas
from .graph_state import _r6

TIMEOUT_SECONDS = 45


def correlate_stages(raw: DataFrame, enriched: DataFrame, changes: DataFrame, timeout_s: int = TIMEOUT_SECONDS) -> DataFrame:
    """raw: (article_id, t_raw); enriched: (article_id, t_enriched, mean_sentiment);
    changes: (article_id, t_change, node_count, edge_count) -> one progress row per article."""
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timeout_s))
    e = enriched.withColumnRenamed("article_id", "_e_id")
    j1 = raw.join(e, (F.col("article_id") == F.col("_e_id")) &
                  F.col("t_enriched").between(F.col("t_raw"), F.col("t_raw") + gap), "left").drop("_e_id")
    j1 = j1.groupBy("article_id", "t_raw").agg(F.min(F.struct("t_enriched", "mean_sentiment")).alias("e")).select("article_id", "t_raw", "e.*")
    c = changes.withColumnRenamed("article_id", "_c_id")
    j2 = j1.join(c, (F.col("article_id") == F.col("_c_id")) & F.col("t_enriched").isNotNull() &
                 F.col("t_change").between(F.col("t_enriched"), F.col("t_enriched") + gap), "left").drop("_c_id")
    j2 = j2.groupBy("article_id", "t_raw", "t_enriched", "mean_sentiment").agg(F.min(F.struct("t_change", "node_count", "edge_count")).alias("c")) \
        .select("article_id", "t_raw", "t_enriched", "mean_sentiment", "c.*")
    return j2.select(
        "article_id",
        F.col("t_enriched").isNotNull().alias("step2"),
        F.col("t_change").isNotNull().alias("step3"),
        F.when(F.col("t_enriched").isNull(), F.lit("step2")).when(F.col("t_change").isNull(), F.lit("step3"))
         .alias("timeout_step"),
        _r6(F.coalesce(F.col("mean_sentiment"), F.lit(0.0))).alias("mean_sentiment"),
        "node_count", "edge_count")


# The types of progress events that carry a payload, and how much of a sentence an entity view shows
STAGES = ("step1", "step2", "step3", "step4", "timeout", "error")
STATUS = "status"
SENTENCE_SHOWN = 120


def entity_view(entities) -> Column:
    """Text, type, sentiment, confidence and the start of the sentence of each mention (an array of mention structs)."""
    def view(e):
        shown = F.substring(F.replace(F.coalesce(e["sentence"], F.lit("")), F.lit("\\n"), F.lit(" ")), 1, SENTENCE_SHOWN)
        return F.struct(F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["type"], F.lit("")).alias("type"),
                        F.coalesce(e["sentiment_score"], F.lit(0.0)).alias("sentiment"),
                        F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"), shown.alias("sentence"))
    return F.transform(F.coalesce(entities, F.array().cast(schemas.ENRICHED["entities"].dataType)), view)


def article_progress(events: DataFrame, order: str, title: str | None = None) -> DataFrame:
    """One row per article: ``first_order`` (order by it for the order of first sight), the latest payload of each
    stage as a struct of the other columns, null if there was none, and the last title of step 1 that is not blank.

    ``events`` has article_id, type, ``order`` (unique) and the payload's columns. Status messages and blank article ids
    are no progress; an unknown type only shows that the article was seen. One aggregation with partial sums, on a
    batch or, in update mode, on a stream.
    """
    rows = events.filter((F.col("article_id").cast("string") != "") & ~F.col("type").eqNullSafe(F.lit(STATUS)))
    payload = F.struct(*[c for c in events.columns if c not in ("article_id", "type")])
    latest = [F.max_by(payload, F.when(F.col("type") == s, F.col(order))).alias(s) for s in STAGES]
    if title is not None:
        shown = (F.col("type") == "step1") & (F.col(title) != "")
        latest.append(F.max_by(title, F.when(shown, F.col(order))).alias("title"))
    return rows.groupBy("article_id").agg(F.min(order).alias("first_order"), *latest)
