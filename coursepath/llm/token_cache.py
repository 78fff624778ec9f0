"""Token counts through a cache of stored counts, keyed by digests of the content and of the tokenizer.

Each run encodes only the distinct contents that the cache doesn't hold for this tokenizer version, and appends them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepath.llm.cross_tokenizer import SPLIT, byte_level_tokens
from coursepath.llm.tables import stored, text_or_empty

_BATCH_CHARS = 1 << 19  # characters encoded at once, or one text if it is longer

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(definition: str) -> str:
    """Digest of the tokenizer's definition and of the library version that applies it."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{definition}".encode()).hexdigest()


def quick_counter(definition: str) -> Callable[[list[str]], list[int]] | None:
    """Counts as the library gives them, by ``tiktoken`` in a fifth of the time; None for a tokenizer that is built otherwise.

    That is byte-level BPE with the usual split, ids in the order of the merges and added tokens without options. Both
    libraries then cut a text at the added tokens and merge the same bytes in the same order.
    """
    spec = json.loads(definition)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    vocabulary = model.get("vocab")
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or not isinstance(vocabulary, dict):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"] for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    tokens = byte_level_tokens(vocabulary)
    ranks = {tokens[i]: i for entry, i in vocabulary.items() if entry not in special}
    if made != sorted(set(made)) or len(ranks) != 256 + len(made):
        return None
    import tiktoken

    bpe = tiktoken.Encoding("quick", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [len(bpe.encode(t, allowed_special="all")) for t in texts]


def library_counter(definition: str) -> Callable[[list[str]], list[int]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(definition: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = quick_counter(definition) or library_counter(definition)
        for batch in batches:
            counts: list[int] = []
            texts, start, chars = list(batch.text), 0, 0
            for k, text in enumerate(texts):
                chars += len(text)
                if chars >= _BATCH_CHARS or k == len(texts) - 1:
                    counts += counted(texts[start : k + 1])
                    start, chars = k + 1, 0
            yield pd.DataFrame({"content": batch.content, "n_tokens": counts})

    return count


def _cached(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if the cache doesn't exist yet. Entries that two runs appended count once."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, definition: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row; ``definition`` is the tokenizer's JSON, ``cache`` a shared folder.

    Normalising content must not change its tokens, so it only turns a null into an empty text (0 tokens). Special strings
    inside a text are handled as the library does by default; none are added, and nothing is cut or padded.
    Repeated texts are encoded once per tokenizer version, ever; ids may be null or repeated. Contents of two runs
    at once may be appended twice, which changes no count.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(definition)
    body = text_or_empty(text)
    marked = docs.select(F.col(f"`{id}`").alias("id"), body.alias("text"), F.sha2(body, 256).alias("content"))
    known = _cached(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # Each task makes its texts distinct first, so a text that very many rows hold is dealt out once a task.
    distinct = marked.select("content", "text").dropDuplicates(["content"])
    missing = distinct.join(known.select("content"), "content", "left_anti")
    counted = missing.mapInPandas(_counter(definition), "content string, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # Stored, so that the join below deals out both sides itself and can split a content that very many rows share.
    counts = stored(
        _cached(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")),
        "token_counts",
    )
    sizes = stored(marked.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    return sizes.join(counts, "content").select(F.col("id").alias(id), "n_bytes", "n_tokens")
