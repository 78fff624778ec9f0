"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie is walked twice. The top of it is small: counts per prefix, refined only where a node holds too many
fingerprints. Its node pairs are traversed together on the driver, which sees prefixes and never a fingerprint.
Each surviving pair of leaves becomes one unit of work, whose fingerprints a task joins by going on with the same
traversal. A task returns a spanning forest of its links, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepath.llm.components import connected_components, forest
from coursepath.llm.tables import stored, text_or_empty

_BITS = 64
_STEP = 8  # bits by which a crowded node of the top is refined
_PACK = 4096  # fingerprints in one packed row
_PAIRS = 1 << 20  # fingerprint pairs compared at once
_FRONTIER = 1 << 16  # node pairs expanded at once


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 (seed 42) of all word shingles; zero for a text without words."""
    words = text.encode("utf-8").lower().split()  # bytes.lower and bytes.split know ASCII letters and blanks only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, n, 65536):
        part = words[at : min(at + 65536, n) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add the fingerprint of the whole text as a long; a null text counts as empty."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(text_or_empty(text)))


# --- the top of the trie -------------------------------------------------------------------------------------

_Node = tuple[int, int]  # depth and prefix


def _top(fps: DataFrame, leaf: int) -> dict[_Node, int]:
    """Fingerprints per node of the trie, down to where every node holds at most ``leaf`` of them."""
    counts: dict[_Node, int] = {}
    rows, depth = fps, 0
    while depth < _BITS:
        depth += _STEP
        found = rows.groupBy(F.shiftrightunsigned("fp", _BITS - depth).alias("p")).count().collect()
        for p, n in found:
            node = (depth, p % (1 << depth))
            for up in range(_STEP + 1):
                key = (depth - up, node[1] >> up)
                if up == _STEP and depth > _STEP:
                    break  # counted by the step before
                counts[key] = counts.get(key, 0) + n
        crowded = [p for p, n in found if n > leaf]
        if not crowded:
            break
        marks = fps.sparkSession.createDataFrame([(p,) for p in crowded], "up long")  # below N / leaf rows
        rows = rows.join(F.broadcast(marks), F.shiftrightunsigned("fp", _BITS - depth) == F.col("up"), "left_semi")
    return counts


def _leaf_pairs(counts: dict[_Node, int], leaf: int, radius: int) -> tuple[list[_Node], list[tuple[int, int]]]:
    """Leaves, and the pairs of them (as positions) whose prefixes differ by ``radius`` bits at most."""
    number: dict[_Node, int] = {}
    pairs = []
    stack = [((0, 0), (0, 0), 0)] if counts else []

    def below(node: _Node) -> list[_Node]:
        if counts[node] <= leaf or node[0] == _BITS:
            return []
        return [c for bit in (0, 1) if (c := (node[0] + 1, 2 * node[1] + bit)) in counts]

    while stack:
        a, b, err = stack.pop()
        under_a, under_b = below(a), below(b)
        if a == b and under_a:
            stack += [(x, y, (x != y) + err) for k, x in enumerate(under_a) for y in under_a[k:]]
        elif not under_a and not under_b:
            pairs.append((number.setdefault(a, len(number)), number.setdefault(b, len(number))))
        elif under_a and under_b and a[0] == b[0]:
            both = ((x, y, err + ((x[1] ^ y[1]) & 1)) for x in under_a for y in under_b)
            stack += [x for x in both if x[2] <= radius]
        elif under_a and (not under_b or a[0] < b[0]):
            stack += [(x, b, _differ(x, b)) for x in under_a if _differ(x, b) <= radius]
        else:
            stack += [(a, y, _differ(a, y)) for y in under_b if _differ(a, y) <= radius]
    return list(number), pairs


def _differ(a: _Node, b: _Node) -> int:
    """Differing bits within the shorter of two prefixes."""
    d = min(a[0], b[0])
    return ((a[1] >> (a[0] - d)) ^ (b[1] >> (b[0] - d))).bit_count()


# --- below the leaves, inside a task -------------------------------------------------------------------------


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the values with the next bit set begin, within ranges that share ``depth`` leading bits."""
    bit = np.uint64(1 << (_BITS - 1 - depth))
    first = values[low] & ~np.uint64((1 << (_BITS - depth)) - 1) | bit
    return np.clip(np.searchsorted(values, first), low, high)


def _compared(a, b, la, ha, lb, hb, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions among all pairs of the given pairs of ranges."""
    size = (ha - la) * (hb - lb)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
        part = slice(start, stop)
        n = size[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat((hb - lb)[part], n)
        i = np.repeat(la[part], n) + k // wide
        j = np.repeat(lb[part], n) + k % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= radius
        if same:
            near &= i < j
        yield i[near], j[near]
        start = stop


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all linked pairs of two sorted arrays, or of one with itself if ``b`` is None."""
    same, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    one = np.array([0])
    stack = [(0, one, np.array([len(a)]), one, np.array([len(b)]), one)]
    while stack:
        depth, la, ha, lb, hb, err = stack.pop()
        small = (ha - la) * (hb - lb) <= 256
        if depth == _BITS:
            small[:] = True
        if small.any():
            yield from _compared(a, b, la[small], ha[small], lb[small], hb[small], same, radius)
            la, ha, lb, hb, err = (x[~small] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        ma, mb = _split(a, la, ha, depth), _split(b, lb, hb, depth)
        grown = []
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            next_ = ((ma, ha) if x else (la, ma)) + ((mb, hb) if y else (lb, mb)) + (err + (x ^ y),)
            keep = (next_[0] < next_[1]) & (next_[2] < next_[3]) & (next_[4] <= radius)
            if same and x > y:
                keep &= la != lb  # the mirror image of (0, 1) under a node paired with itself
            grown.append([v[keep] for v in next_])
        joined = [np.concatenate(v) for v in zip(*grown)]
        for at in range(0, len(joined[0]), _FRONTIER):
            stack.append((depth + 1, *(v[at : at + _FRONTIER] for v in joined)))


def _join_unit(radius: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [np.sort(np.concatenate([np.asarray(x, np.int64) for x in rows.fps[rows.side == s]] or [np.empty(0, np.int64)]).view(np.uint64)) for s in (0, 1)]
        n = len(sides[0])
        pairs = linked(sides[0], None, radius) if not len(sides[1]) else ((i, j + n) for i, j in linked(*sides, radius))
        both = np.concatenate(sides).view(np.int64)
        root = forest(len(both), pairs)
        moved = np.flatnonzero(root != np.arange(len(both)))
        return pd.DataFrame({"a": both[moved], "b": both[root[moved]]})

    return join


def fingerprint_links(fps: DataFrame, radius: int = 3, leaf: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all of the distinct fingerprints ``fp`` within ``radius`` bits of each other.

    The links are a spanning forest of each unit of work, so they keep every connection but not every pair.
    ``leaf`` bounds the fingerprints of a leaf; by default it grows slowly with the table, to 4 million (32 MB).
    """
    spark = fps.sparkSession
    leaf = leaf or min(max(16_384, fps.count() // 1024), 1 << 22)
    counts = _top(fps, leaf)
    leaves, pairs = _leaf_pairs(counts, leaf, radius)
    if not leaves:
        return spark.createDataFrame([], "a long, b long")
    wrap = lambda p, depth: p if depth < _BITS or p < 1 << 63 else p - (1 << 64)
    node = spark.createDataFrame(
        [(d, wrap(p, d), k, -(-counts[d, p] // _PACK)) for k, (d, p) in enumerate(leaves)],
        "depth int, prefix long, leaf int, packs int",
    )
    depths = sorted({d for d, _ in leaves})
    placed = fps.select("fp", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn(
        "prefix", F.expr(f"if(depth = 0, 0L, shiftrightunsigned(fp, {_BITS} - depth))")
    )
    packed = (
        placed.join(node, ["depth", "prefix"])
        .groupBy("leaf", F.pmod(F.xxhash64("fp"), "packs").alias("pack"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    sides = pd.DataFrame(
        [(u, x, s) for u, (a, b) in enumerate(pairs) for s, x in enumerate((a, b)[: 1 + (a != b)])],
        columns=["unit", "leaf", "side"],
    )
    units = spark.createDataFrame(sides, "unit int, leaf int, side int")
    work = packed.join(units, "leaf").select("unit", "side", "fps")
    return work.groupBy("unit").applyInPandas(_join_unit(radius), "a long, b long")


def component_roots(fps: DataFrame, radius: int = 3, leaf: int | None = None) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint that links with another: ``root`` is one fingerprint of the component."""
    found = stored(fingerprint_links(fps, radius, leaf), "fingerprint_links")
    return connected_components(found).withColumnRenamed("node", "fp")


def simhash_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, leaf: int | None = None
) -> DataFrame:
    """``(id, fp, component)`` for every row: fingerprint and least id reachable over links of ``radius`` bits.

    Empty and null texts have fingerprint zero, which is linked like any other. Repeated rows stay and share their
    component. A null id never becomes a component while the component has another id. Other columns are ignored.
    """
    marked = stored(
        with_fingerprint(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), shingle=shingle).select("id", "fp"),
        "fingerprints",
    )
    reps = stored(marked.groupBy("fp").agg(F.min("id").alias("rep")), "distinct_fingerprints")
    linked_reps = reps.join(component_roots(reps.select("fp"), radius, leaf), "fp")
    least = linked_reps.groupBy("root").agg(F.min("rep").alias("component"))
    named = linked_reps.join(least, "root").select("fp", "component")
    component = stored(
        reps.join(named, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component")), "components"
    )
    return marked.join(component, "fp").select(F.col("id").alias(id), "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
