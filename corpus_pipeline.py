"""From raw documents to packed batches: toxicity, near-duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepath.llm import decontamination, packing, simhash_trie, surrogates, toxicity
from coursepath.llm.queries import PII_PARAMS, is_held_out
from coursepath.llm.tables import free_name, read, stored, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose calibrated chance of being toxic is one half or more.

    Labels of the fifth that is held out for measuring are not learned from.
    """
    score = free_name(docs, "toxicity")
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels").where(~is_held_out()), score=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least ``doc_id``, of several the least fingerprint, of several any.

    Rows are judged one by one, so repeated ids are documents of their own. A row without an id stays only if its whole group has none.
    """
    row, print_, gone = (free_name(docs, c) for c in ("row_of_stage", "fingerprint_of_row", "gone_row"))
    marked = stored(simhash_trie.with_fingerprint(docs, out=print_).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    rows = marked.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.col(print_).alias("fp"))
    roots = stored(simhash_trie.component_roots(stored(rows.select("fp").distinct(), "distinct_fingerprints")), "fingerprint_roots")
    grouped = stored(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near_duplicate_groups")
    first = F.min(F.struct(F.col("id").isNull(), "id", "fp", "row"))["row"]
    kept = stored(grouped.groupBy("root").agg(first.alias("kept")), "kept_rows")
    others = grouped.join(kept, "root").where("row <> kept").select(F.col("row").alias(gone))
    return without(marked, others, F.col(row) == F.col(gone)).drop(row, print_)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates in place of personal data."""
    return surrogates.replace_pii(docs, PII_PARAMS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its length, bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack),
]

# Trained trees and a keyed hash are beyond SQL; the tests compare the stages that decide by rule with brute force, the others by what
# they must and must not change.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
