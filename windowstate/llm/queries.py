"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.llm import (ann_polytope, conversation_repair, decontaminate, exact_dedup, importance, license_scan,
                             line_dedup, mixing, near_dup, pii, quality_fm, suffix_dedup, url_filter)
from windowstate.llm.common import alnum_words


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(col) -> F.Column:
    return F.sha2(col, 256)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"),
                      F.col("__copies").alias("copies"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.train(docs, _read(spark, sf_dir, "labels"))
    out = quality_fm.score_quality(docs, model)
    return out.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every page."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    out = decontaminate.flag_contaminated(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", F.col("__n_hit").alias("n_hit"), F.col("__n_items").alias("n_items"),
                      _sha(F.array_join("__item_ids", ",")).alias("items_sha256"),
                      (F.col("__n_hit") > 0).alias("contaminated"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    out = license_scan.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "__license.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document; the operator itself returns the kept text."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                      _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score) of every document."""
    found = pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", "__pii")
    base = [k for k in pii.KINDS if k.base]
    n = [pii.count_of(F.col("__pii"), k.name).alias(f"n_{k.name}") for k in base]
    of_base = F.filter("__pii", lambda s: s["kind"] < len(base))
    return found.select("doc_id", *n, _sha(pii.spans_text(of_base)).alias("base_sha256"),
                        pii.spans_text(F.col("__pii")).alias("spans"),
                        F.coalesce(F.array_max(F.transform("__pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; the operator also gives the ranges."""
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 5 nearest found of every vector whose id is divisible by 50."""
    return ann_polytope.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                               F.col("vec_id") % 50 == 0)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document."""
    return importance.resample(_read(spark, sf_dir, "documents").select("doc_id", "text"),
                               _read(spark, sf_dir, "benchmark").select("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    _, stream = conversation_repair.repair(conversation_repair.damage(rows), rows.select("conv_id"))
    return conversation_repair.repaired_hashes(stream)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))


LLM_QUERIES = {
    "op11_importance": op11_importance,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
    "op7_ann": op7_ann,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op10_near_dup": op10_near_dup,
    "op1_mix_sources": op1_mix_sources,
    "op2_quality": op2_quality,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
}
