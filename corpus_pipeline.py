"""Training-data pipeline: five stages over `documents`, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as Parquet and rereads as the
next stage's docs. All but the last return the columns of documents; the last adds `copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowstate.llm import decontaminate, line_dedup, mixing, near_dup, quality_fm
from windowstate.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under 0.5."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score_quality(docs, model).where(F.col("__score") >= 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; a document that loses lines gets its new n_chars,
    one that loses all of them goes."""
    out = line_dedup.dedup_lines(docs)
    cut = F.col("__n_removed") > 0
    n_chars = F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return (out.where(~cut | (F.col("__n_removed") < F.col("__n_lines"))).withColumn("n_chars", n_chars)
            .select(*docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: of the smallest id the first by text hash. Rows without id are
    a group for each text."""
    kept = near_dup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(
        F.col("doc_id").alias("__kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")
    digest = F.md5("text")
    place = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), digest))
                                .orderBy(digest, F.xxhash64(*docs.columns)))
    return rows.withColumn("__place", place).where(F.col("__place") == 1).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.flag_contaminated(docs, items).where("__n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each."""
    return mixing.mix(docs).where("__copies > 0").select(*docs.columns, F.col("__copies").alias("copies"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix_sources),
]

# A learned score and rounding by seeded draws are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written under spark.checkpoint.dir and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
