import itertools
import random

from pyspark.sql import functions as F

from coursepath.llm import packing as P

from .fixtures import documents


def brute(bins, buckets):
    best = None
    edges = [b[0] for b in bins]
    for k in range(1, buckets + 1):
        for cut in itertools.combinations(edges[:-1], min(k - 1, len(edges) - 1)):
            bounds = [*cut, edges[-1]]
            pad = sum(next(b for b in bounds if e <= b) * c - t for e, c, t in bins)
            best = pad if best is None else min(best, pad)
    return best


def test_bounds_have_the_least_padding():
    rng = random.Random(1)
    for _ in range(200):
        edges = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
        bins = [(e, c := rng.randint(1, 9), c * e - rng.randint(0, 3)) for e in edges]
        k = rng.randint(1, 5)
        bounds, padding = P.best_bounds(bins, k)
        assert padding == brute(bins, k) and len(bounds) <= k and bounds[-1] == edges[-1]
        assert padding == sum(next(b for b in bounds if e <= b) * c - t for e, c, t in bins)
    assert P.best_bounds([], 4) == ([], 0)


def test_bounds_of_long_texts_are_lengths_that_occur(spark):
    lengths = [3, 5, 4095, 4097, 5001, 5001, 5003, 8191, 8193, 9001, 20_001]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    out = P.pack(rows, P.PackingParams(buckets=5), length=F.col("n")).collect()
    assert {r.bucket_length for r in out} <= set(lengths)
    bins = [(k, len(list(g)), 0) for k, g in itertools.groupby(sorted(lengths))]
    assert sum(r.padding for r in out) == brute([(k, c, k * c) for k, c, _ in bins], 5)


def test_every_document_is_in_one_batch_within_budget(spark):
    rng = random.Random(2)
    texts = [(i, " ".join("x" * rng.randint(0, 80))) for i in range(400)] + [(500, None), (501, ""), (502, " \n"), (503, "y " * 3000), (1, "a b"), (1, "a b"), (None, "q")]
    params = P.PackingParams(buckets=4, tokens_per_batch=256, rows_per_shard=50)
    rows = P.pack(documents(spark, texts), params).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len((t or "").split())) for i, t in texts)
    batches = {}
    for r in rows:
        assert 0 <= r.padding == r.bucket_length - r.n_tokens
        batches.setdefault(r.batch, []).append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1
        assert len(b) == 1 or len(b) * max(1, b[0].bucket_length) <= 256
    assert len({r.bucket_length for r in rows}) == 4
    sizes = sorted((n, 1, n) for n in (len((t or "").split()) for _, t in texts))
    merged = [(k, len(g), k * len(g)) for k, g in ((k, list(g)) for k, g in itertools.groupby(sizes, key=lambda x: x[0]))]
    assert sum(r.padding for r in rows) == P.best_bounds(merged, 4)[1]


def test_no_documents(spark):
    out = P.pack(documents(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "padding"]
