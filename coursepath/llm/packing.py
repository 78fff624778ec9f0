"""Packing into length buckets whose bounds minimise padding, and token-budget batches within each bucket.

Only the histogram of exact lengths comes to the driver: two numbers for each length that occurs. L different lengths take
L^2/2 tokens at the least, so even ten million million tokens have under five million of them. Dynamic programming over them
finds the bounds, each a length that occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursepath.llm.tables import free_name, stored, text_or_empty


@dataclass(frozen=True)
class PackingParams:
    buckets: int = 16
    tokens_per_batch: int = 16_384
    rows_per_shard: int = 20_000  # documents batched by one group of rows, about


def word_count(text: str = "text") -> Column:
    """Runs of non-blank characters; 0 for null, empty and blank texts."""
    trimmed = F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def best_bounds(bins: list[tuple[int, int, int]], buckets: int) -> tuple[list[int], int]:
    """Bucket bounds with the least padding, and that padding.

    ``bins`` are ``(edge, documents, tokens)`` in order of their edges. A bucket pads its documents to its bound,
    which is an edge. Padding of a bucket over the bins ``(i, j]`` is ``edge_j * (C_j - C_i) - (T_j - T_i)`` with running sums
    C and T, so each step minimises lines in the edge; a hull of the lines makes a step linear in the bins.
    """
    edges = [b[0] for b in bins]
    docs, tokens = [0], [0]
    for _, c, t in bins:
        docs.append(docs[-1] + c)
        tokens.append(tokens[-1] + t)
    n = len(bins)
    if not n:
        return [], 0
    best = [edges[j - 1] * docs[j] - tokens[j] if j else 0 for j in range(n + 1)]
    choice = [[0] * (n + 1)]
    for _ in range(min(buckets, n) - 1):
        # Line i at edge x: best[i] + tokens[i] - docs[i] * x. Slopes fall as i grows and x grows too.
        hull: list[int] = []
        new, picked, head = best[:], [0] * (n + 1), 0
        value = lambda i, x: best[i] + tokens[i] - docs[i] * x

        def useless(a: int, b: int, c: int) -> bool:
            left = (best[c] + tokens[c] - best[a] - tokens[a]) * (docs[b] - docs[a])
            return left <= (best[b] + tokens[b] - best[a] - tokens[a]) * (docs[c] - docs[a])

        for j in range(1, n + 1):
            i = j - 1
            if not hull or docs[i] > docs[hull[-1]]:
                while len(hull) - head >= 2 and useless(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            x = edges[j - 1]
            while head + 1 < len(hull) and value(hull[head + 1], x) <= value(hull[head], x):
                head += 1
            new[j] = value(hull[head], x) + x * docs[j] - tokens[j]
            picked[j] = hull[head]
        best, choice = new, [*choice, picked]
    bounds, j = [], n
    for picked in reversed(choice):
        if j:
            bounds.append(edges[j - 1])
            j = picked[j]
    return bounds[::-1], best[n]


def pack(docs: DataFrame, params: PackingParams = PackingParams(), id: str = "doc_id", length: Column | None = None) -> DataFrame:
    """``(id, n_tokens, bucket, bucket_length, batch, padding)`` for every row.

    ``length`` is the token count of a row, by default its words. A bucket takes the lengths up to its bound and above the bound
    before. A batch holds rows of one bucket whose padded sizes stay within the budget; a row longer than the
    budget is a batch of its own, whole. Null and empty texts have length 0 and share batches of as many rows as the budget
    has tokens. Rows are numbered within shards of a bucket, so no group holds a whole bucket; each shard may leave
    one batch part full. Repeated rows and null ids are rows like any other. ``batch`` is unique over all buckets.
    """
    sized = stored(
        docs.select(F.col(f"`{id}`").alias("id"), (word_count() if length is None else length).cast("long").alias("n_tokens")),
        "lengths",
    )
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("c")).toPandas().sort_values("n_tokens")
    bins = [(n, c, n * c) for n, c in zip(histogram.n_tokens.tolist(), histogram.c.tolist())]
    bounds, _ = best_bounds(bins, params.buckets)
    if not bounds:
        return sized.select(F.col("id").alias(id), "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("padding"))
    counts = [sum(c for n, c, _ in bins if low < n <= high) for low, high in zip([-1, *bounds], bounds)]
    shards = [max(1, -(-c // params.rows_per_shard)) for c in counts]
    capacity = [max(1, params.tokens_per_batch // max(1, b)) for b in bounds]
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)
    placed = (
        sized.withColumn("bucket", sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds), F.lit(0)))
        .withColumn("bucket_length", pick(bounds))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("shard", F.pmod(F.xxhash64("id", "row"), pick(shards)))
    )
    order = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "id", "row")
    number = F.floor((F.row_number().over(order) - 1) / pick(capacity))
    return placed.select(
        F.col("id").alias(id),
        "n_tokens",
        "bucket",
        "bucket_length",
        F.concat_ws("-", "bucket", "shard", number).alias("batch"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
