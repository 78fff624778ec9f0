"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

1. Windows are only built in documents that can hold a match. A window of similarity ``t`` to an item shares so
   many shingles with it that one of them stands at every k-th word, so looking at every k-th shingle of a document
   finds every such document (:func:`safe_stride`). No match is lost by this.
2. In those documents, every place that enough shared shingles follow within an item's size starts windows of that size,
   one for each start that can hold as many. A window of the similarity holds that many, in whatever order, so none is lost.
3. Windows and items get a 64-bit SimHash over their words. A multi-index over blocks of the fingerprint finds all
   pairs within the radius: with more blocks than differing bits, some block agrees.
4. The multiset (weighted Jaccard) similarity of five-word shingles verifies each candidate exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepath.llm.tables import free_name, stored, text_or_empty, without


@dataclass(frozen=True)
class DecontaminationParams:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 27  # bits; none of 320,000 simulated pairs at the similarity differed in more than 24 of 64
    broadcast_rows: int = 1_000_000  # item shingles (24 bytes each) or document ids up to which a side is broadcast


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def safe_stride(least: int, most: int, similarity: float) -> int:
    """The largest k for which looking at every k-th shingle meets a shared one in every window that matches.

    A window of m shingles and an item of as many or more share ``s >= 2t / (1 + t) * m`` of them, so at most
    ``u = (1 - t) / (1 + t) * m`` shingles of the window are not shared. Every k-th shingle is at least
    ``m // k`` of them, and one is shared if that is above u. Windows at the edge of a text may be shorter, down to t times the item.
    """
    sizes = range(max(1, ceil(similarity * least)), most + 1)
    apart = (1 - similarity) / (1 + similarity)
    good = [k for k in range(1, max(2, sizes.start + 1)) if all(m // k > int(apart * m + 1e-9) for m in sizes)]
    return max(good, default=1)


def least_shared(n: Column | str, m: Column | str, similarity: float) -> str:
    """SQL: how many shingles two bags of ``n`` and ``m`` shingles have in common at least, if they are so similar."""
    return f"CAST(ceil({similarity / (1 + similarity)!r}D * ({n} + {m}) - 1e-9D) AS INT)"


def simhash(hashes: list[Column], n: Column) -> Column:
    """The 64-bit SimHash from 64 counts of set bits among ``n`` hashes: a bit is 1 if set in over half."""
    bits = [F.when(2 * c > n, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i, c in enumerate(hashes)]
    return reduce(lambda a, b: a.bitwiseOR(b), (b.cast("long") for b in bits))


def with_simhash(df: DataFrame, key: list[str], words: str) -> DataFrame:
    """One row per ``key`` with the SimHash ``fp`` of the words; rows of one key hold the same words."""
    one = df.select(*key, F.explode(words).alias("w")).select(*key, F.xxhash64("w").alias("h"))
    ones = [F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    counts = one.groupBy(*key).agg(F.count("*").alias("n"), *ones)
    return counts.select(*key, simhash([F.col(f"b{i}") for i in range(64)], F.col("n")).alias("fp"))


def blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each of the ``radius + 1`` blocks of the fingerprint: its number and its bits."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    parts = [
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
        for a, b in zip(edges, edges[1:])
    ]
    return df.select("*", F.posexplode(F.array(*parts)).alias("block", "bits"))


def _shingle_at(words: str, pos: str, size: int) -> list[Column]:
    return [F.expr(f"{words}[{pos} + {k}]") for k in range(size)]


def _positions(df: DataFrame, size: int, stride: int = 1) -> DataFrame:
    return df.where(F.size("words") >= size).withColumn("pos", F.explode(F.expr(f"sequence(0, size(words) - {size}, {stride})")))


def _bag(df: DataFrame, key: str, size: int) -> DataFrame:
    """``(key, shingle, n)``: how often each shingle stands in the words of a key."""
    at = _positions(df, size).select(key, F.concat_ws(" ", *_shingle_at("words", "pos", size)).alias("shingle"))
    return at.groupBy(key, "shingle").agg(F.count("*").alias("n"))


def contaminated(
    docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), id: str = "doc_id", item: str = "item_id", text: str = "text"
) -> DataFrame:
    """``(id, item, similarity, start, n_words)``: the best window of each document and item that match.

    ``start`` counts words from 0; among equal windows it is the first. A document shorter than an item is one window. Null and empty
    texts match nothing. An item of fewer words than a shingle is one shingle as a whole, so it is found where its words stand in a
    row. Repeated rows of a document give one result; a null id is an id of its own. Items with equal texts each get their rows.
    """
    size = params.shingle
    bench = stored(
        items.select(F.col(f"`{item}`").alias("item"), words_of(text_or_empty(text)).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("n_words", F.size("words"))
        .withColumn("ikey", F.md5(F.concat_ws(" ", "words")))
        .distinct(),
        "benchmark",
    )
    corpus = docs.select(F.col(f"`{id}`").alias("id"), words_of(text_or_empty(text)).alias("words"))
    found = []
    # Shingles of the usual size, and of fewer words for items that have no more.
    kinds = bench.select(F.least("n_words", F.lit(size)).alias("size"), "n_words").groupBy("size").agg(F.min("n_words"), F.max("n_words")).collect()
    for words, least, most in sorted(map(tuple, kinds), reverse=True):
        found.append(_by_windows(corpus, bench.where(F.least("n_words", F.lit(size)) == words), (least, most), words, params))
    if not found:
        found.append(docs.sparkSession.createDataFrame([], corpus.select("id").schema).join(bench.select("item").limit(0)).select("id", "item", F.lit(1.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words")))
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"id": id, "item": item})


def _by_windows(corpus: DataFrame, bench: DataFrame, span: tuple[int, int], size: int, params: DecontaminationParams) -> DataFrame:
    """Matches of the items of ``bench``, which have ``span`` words, by shingles of ``size`` words."""
    anchors = _positions(bench, size).select(F.xxhash64(*_shingle_at("words", "pos", size)).alias("h"), "n_words").distinct()
    hashes = stored(anchors, "benchmark_shingles")
    small = hashes.count() <= params.broadcast_rows
    side = lambda df: F.broadcast(df) if small else df

    stride = safe_stride(span[0] - size + 1, span[1] - size + 1, params.similarity)
    seen = (
        _positions(corpus, size, stride)
        .select("id", F.xxhash64(*_shingle_at("words", "pos", size)).alias("h"))
        .join(side(hashes.select("h").distinct()), "h", "left_semi")
        .select("id")
        .distinct()
    )
    ids = stored(seen.withColumnRenamed("id", "seen"), "documents_with_shared_shingles")
    few = F.broadcast(ids) if ids.count() <= params.broadcast_rows else ids
    matched = stored(
        corpus.join(few, F.col("id").eqNullSafe(F.col("seen")), "left_semi").select(F.monotonically_increasing_id().alias("row"), "id", "words"),
        "matched_documents",
    )
    shared = (
        _positions(matched.select("row", "words"), size)
        .select("row", "pos", F.xxhash64(*_shingle_at("words", "pos", size)).alias("h"), F.size("words").alias("n"))
        .join(side(hashes), "h")
        .groupBy("row", "n", "n_words")
        .agg(F.array_sort(F.collect_set("pos")).alias("at"))
    )
    # Shingles of a window and of the item, and how many they share at least.
    window, whole = f"(least(n, n_words) - {size - 1})", f"(n_words - {size - 1})"
    shared = shared.withColumns({"m": F.expr(window), "need": F.expr(least_shared(window, whole, params.similarity))})
    full = F.expr("filter(at, (p, i) -> get(at, i + need - 1) <= p + m - 1)")
    first, last = "greatest(0, p - (m - need))", "least(p, greatest(0, n - n_words))"
    starts = (
        shared.where(F.size("at") >= F.col("need"))
        .select("row", "n", "n_words", "m", "need", F.explode(full).alias("p"))
        .where(f"{first} <= {last}")
        .select("row", "n_words", F.explode(F.expr(f"sequence({first}, {last})")).alias("start"))
        .distinct()
    )
    windows = stored(
        starts.join(matched, "row").select("id", "n_words", "start", F.expr("slice(words, start + 1, n_words)").alias("words")).withColumn("wkey", F.md5(F.concat_ws(" ", "words"))),
        "windows",
    )
    # The same window in many documents is hashed and compared once.
    kinds = stored(windows.groupBy("wkey", "n_words").agg(F.first("words").alias("words")), "distinct_windows")
    left = blocks(with_simhash(kinds, ["wkey", "n_words"], "words"), params.radius)
    unique = bench.groupBy("ikey", "n_words").agg(F.first("words").alias("words"))
    right = blocks(with_simhash(unique, ["ikey", "n_words"], "words"), params.radius).withColumnRenamed("fp", "ifp")
    pairs = stored(
        left.join(right, ["n_words", "block", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= params.radius)
        .select("wkey", "ikey", "n_words")
        .distinct(),
        "window_candidates",
    )
    bags_w = _bag(kinds.select("wkey", "words").dropDuplicates(["wkey"]), "wkey", size)
    bags_i = _bag(unique.select("ikey", "words"), "ikey", size).withColumnRenamed("n", "m")
    total_w = bags_w.groupBy("wkey").agg(F.sum("n").alias("tw"))
    total_i = bags_i.groupBy("ikey").agg(F.sum("m").alias("ti"))
    common = pairs.join(bags_w, "wkey").join(bags_i, ["ikey", "shingle"]).groupBy("wkey", "ikey", "n_words").agg(F.sum(F.least("n", "m")).alias("s"))
    alike = (
        common.join(total_w, "wkey")
        .join(total_i, "ikey")
        .withColumn("similarity", F.col("s") / (F.col("tw") + F.col("ti") - F.col("s")))
        .where(F.col("similarity") >= params.similarity)
        .select("wkey", "ikey", "n_words", "similarity")
    )
    hits = windows.select("id", "n_words", "start", "wkey").join(alike, ["wkey", "n_words"]).join(bench.select("item", "ikey"), "ikey")
    best = hits.groupBy("id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "start", "n_words")).alias("b"))
    return best.select("id", "item", (-F.col("b.minus")).alias("similarity"), "b.start", "b.n_words")


def decontaminate(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams(), id: str = "doc_id") -> DataFrame:
    """The documents without those that match an item; all columns stay. Texts under one id, or without an id, are judged one by one."""
    row, name = free_name(docs, "id_and_words"), free_name(docs, "contaminated_id")
    marked = docs.withColumn(row, F.struct(F.col(f"`{id}`").alias("id"), F.md5(F.concat_ws(" ", words_of(text_or_empty("text")))).alias("words")))
    bad = contaminated(marked, items, params, row).select(F.col(row).alias(name)).distinct()
    return without(marked, bad, F.col(row).eqNullSafe(F.col(name))).drop(row)
