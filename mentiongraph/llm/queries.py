"""Registered queries of the training-data operators, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from . import (bpe_codec, fingerprints, lm_scoring, ngram_join, packing, periodic_runs, piece_codec, quality_rules, secret_scan, spelling,
               substring_dedup, token_count, token_store)
from .common import read_documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    return token_count.token_counts(read_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


@register("op2_token_store")
def op2_token_store(spark, sf_dir):
    return token_store.write_store(read_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1).digests()


@register("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(read_documents(spark, sf_dir), n=5, percent=75)


@register("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return lm_scoring.cross_entropy_difference(read_documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))


@register("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(read_documents(spark, sf_dir, "doc_id", "text", "lang"))


@register("op6_simhash_fingerprints")
def op6_simhash_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(read_documents(spark, sf_dir), query_step=50, radius=5, weighted=True)


@register("op7_length_bucket_packing")
def op7_length_bucket_packing(spark, sf_dir):
    return packing.pack_documents(read_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(read_documents(spark, sf_dir))


@register("op9_bpe_codec")
def op9_bpe_codec(spark, sf_dir):
    return bpe_codec.digests(read_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@register("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.removal_digest(read_documents(spark, sf_dir), window=35)


@register("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    words = spelling.word_counts(read_documents(spark, sf_dir), shortest=7, least=2, change=spelling.dropped_letter)
    return spelling.variants(words, ratio=10)


@register("op12_piece_codec")
def op12_piece_codec(spark, sf_dir):
    return piece_codec.digests(read_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(read_documents(spark, sf_dir), least=12, edit=periodic_runs.planted_periods)
