"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepath.llm import (
    cross_tokenizer,
    decontamination,
    embedding_pq,
    licenses,
    line_store,
    masked_lm,
    packing,
    periodic_runs,
    simhash_trie,
    surrogates,
    token_cache,
    toxicity,
    url_filter,
)
from coursepath.llm.tables import new_path, read

PII_PARAMS = surrogates.SurrogateParams(key="key-of-the-checks")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the best window for each item."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement. A real run takes its key from the operator, not from code."""
    docs = read(spark, sf_dir, "documents")
    return surrogates.replace_pii(docs, PII_PARAMS, count="n_entities").select("doc_id", "text", "n_entities")


def is_held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(
        read(spark, sf_dir, "documents").select("doc_id", "text"),
        read(spark, sf_dir, "labels").where(~is_held_out()),
    )
    return scored.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


URL_RULES = [
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
]


def op3_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op5_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_pq.near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of its own, empty at first, so that each call encodes all distinct texts."""
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    counts = token_cache.count_tokens(read(spark, sf_dir, "documents"), definition, new_path(spark, "token_cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, encoded = masked_lm.train_masked_lm(read(spark, sf_dir, "documents"))
    return masked_lm.score_encoded(encoded, model)


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_trie.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash_trie.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id")
    )


def op11_line_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of each document, by a store of its own that takes in the whole table first."""
    docs = read(spark, sf_dir, "documents")
    store = line_store.LineStore(spark, new_path(spark, "line_store"))
    store.insert(docs)
    kept = store.deduplicated(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = cross_tokenizer.Tokenizers(
        Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"),
        Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes(),
    )
    written = cross_tokenizer.align_tokenizers(
        read(spark, sf_dir, "documents"), pair, groups=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))
    ).documents
    return written.withColumnRenamed("groups", "groups_sha256")


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tail that repeats its first words, in a tenth of the documents that the id's digest chooses; a null id is none of them."""
    digest, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or digest % 10 or not n:
        return words
    first = digest // 10 % n
    period = 1 + (n - first) // (3 + digest // 10 % 8)
    return words[:first] + [words[first + k % period] for k in range(n - first)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted_period)
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("x"), (-r.period).alias("y"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("most", greatest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.x")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.y")).alias("period"),
        F.expr("1000 * most.length div -most.y").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_url_models": op3_url_models,
    "op4_toxicity_trees": op4_toxicity_trees,
    "op5_embedding_pq": op5_embedding_pq,
    "op6_license_dice": op6_license_dice,
    "op7_token_cache": op7_token_cache,
    "op8_packing": op8_packing,
    "op9_masked_lm": op9_masked_lm,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_line_store": op11_line_store,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_periodic_runs": op13_periodic_runs,
}
