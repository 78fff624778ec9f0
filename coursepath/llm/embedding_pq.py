"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length one. Coarse lists and residual codebooks are fitted on a bounded sample; every vector is indexed. A
vector probes every list that can hold a neighbour: its distance to the plane between its own centroid and the other
one is within the link radius. Table-lookup distances carry the stored error of each code, so that they never rule
out a neighbour; an exact cosine in double precision decides. So the answer is exact, and the quantiser only sets its cost.

Equal vectors are one class with a size. Lists and their visitors are dealt out in bounded blocks, and a task returns
counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursepath.llm.components import connected_components, forest
from coursepath.llm.tables import stored

_ROWS = 8_192  # rows of the index or of visits that a task makes at once
_SLACK = 1e-6  # distances are rounded; candidates get this much room
_SQUARE_SLACK = 1e-5  # and sums of looked-up squares, which are in single precision, this much


@dataclass(frozen=True)
class PQParams:
    similarity: float = 0.95
    sample: int = 16_384  # vectors the quantiser is fitted on, about; fewer if they are very long
    sample_values: int = 8_000_000
    vectors_per_list: int = 500
    most_lists: int = 4_096
    subspace: int = 8  # components of a subspace
    codes: int = 64  # codes of a subspace
    rounds: int = 8  # of k-means
    block: int = 2_048  # vectors of one side of a unit of work, about
    seed: int = 11


def scaled(vectors) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component to between a half and one.

    Exact, and no square under- or overflows, so very small and very large finite vectors have a direction like any other.
    """
    x = np.stack(list(vectors)).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(vectors) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


class Quantiser:
    """Coarse centroids and residual codebooks of one vector length."""

    def __init__(self, sample, lists: int, params: PQParams):
        rng = np.random.default_rng(params.seed)
        x = unit(sample)
        self.radius = sqrt(2 - 2 * params.similarity)
        self.centers = _kmeans(x, lists, params.rounds, rng)
        self.cuts = list(range(0, x.shape[1], params.subspace))
        rest = x - self.centers[self.nearest(x)]
        self.books = [_kmeans(rest[:, c : c + params.subspace], params.codes, params.rounds, rng) for c in self.cuts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centers.T - (self.centers**2).sum(1) / 2).argmax(1)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what the codes leave out."""
        codes, left = [], np.zeros(len(rest))
        for c, book in zip(self.cuts, self.books):
            part = rest[:, c : c + book.shape[1]]
            code = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            codes.append(code)
            left += ((part - book[code]) ** 2).sum(1)
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(left)

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which later lists can hold a vector within the radius: a row of flags for each vector.

        A vector of list j is nearer to centroid j than to centroid i, so one of list i within the radius is at most so far
        from the plane between the centroids. Pairs are found from the lower list.
        """
        c = self.centers
        square = (c**2).sum(1) - 2 * (x @ c.T)
        gap = square - square[np.arange(len(x)), own][:, None]
        norm = (c**2).sum(1)
        apart = np.sqrt(np.maximum(norm[own][:, None] + norm - 2 * c[own] @ c.T, 0))
        return (gap <= 2 * apart * (self.radius + _SLACK)) & (np.arange(len(c)) > own[:, None])


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _members(q: Quantiser):
    """Rows of the index, with codes."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at : at + _ROWS] for b in batches for at in range(0, len(b), _ROWS)):
            x = unit(batch.v)
            own = q.nearest(x)
            codes, left = q.encode(x - q.centers[own])
            yield pd.DataFrame({"list": own, "c": batch.c, "n": batch.n, "v": batch.v, "codes": [r.tobytes() for r in codes], "error": left})

    return place


def _visits(q: Quantiser):
    """Rows of the visits to other lists."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Visits multiply the rows: only so many vectors at once that few rows are in memory.
        step = max(1, 4 * _ROWS // len(q.centers))
        for part in (b.slice(at, step) for b in batches for at in range(0, len(b), step)):
            x = unit(part.column(2).flatten().to_numpy().reshape(len(part), -1))
            i, j = np.nonzero(q.probes(x, q.nearest(x)))
            rows = [pa.array(j, pa.int32()), *(part.column(k).take(pa.array(i)) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(i), pa.binary()), pa.array(np.zeros(len(i)))], ["list", "c", "n", "v", "codes", "error"])

    return place


def _unit(q: Quantiser, similarity: float):
    """Links within a unit of work: the members of a block against those of another block, or against visitors."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.side == 0], rows[rows.side == 1]
        same = bool(rows.alone.iloc[0])
        b = a if same else b
        none = pd.DataFrame({"c": [], "links": [], "root": []}).astype("int64")
        if a.empty or b.empty:
            return none
        wide = [scaled(s.v) for s in (a, b)]
        norm = [np.linalg.norm(w, axis=1) for w in wide]
        ids = np.concatenate([a.c.to_numpy(), [] if same else b.c.to_numpy()]).astype(np.int64)
        size = [s.n.to_numpy() for s in (a, b)]
        codes = np.stack([np.frombuffer(x, np.uint8) for x in a.codes]).T.astype(np.intp)
        limit = ((q.radius + a.error.to_numpy() + _SLACK) ** 2 + _SQUARE_SLACK).astype(np.float32)[:, None]
        count = np.zeros(len(ids), np.int64)
        shift = 0 if same else len(a)
        center = q.centers[int(a.list.iloc[0])]

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(b), 256):
                rest = wide[1][at : at + 256] / norm[1][at : at + 256, None] - center
                # Members by visitors: a code picks a whole row of its table.
                square, picked = np.zeros((2, len(a), len(rest)), np.float32)
                for code, cut, book in zip(codes, q.cuts, q.books):
                    part = rest[:, cut : cut + book.shape[1]]
                    table = (part**2).sum(1) - 2 * book @ part.T + (book**2).sum(1)[:, None]
                    square += np.take(table.astype(np.float32), code, axis=0, out=picked, mode="clip")
                x, y = np.nonzero(square <= limit)
                y += at
                if same:
                    x, y = x[x < y], y[x < y]
                for part in range(0, len(x), 50_000):
                    i, j = x[part : part + 50_000], y[part : part + 50_000]
                    cos = np.einsum("ij,ij->i", wide[0][i], wide[1][j]) / (norm[0][i] * norm[1][j])
                    i, j = i[cos >= similarity], j[cos >= similarity]
                    np.add.at(count, i, size[1][j])
                    np.add.at(count, j + shift, size[0][i])
                    yield i, j + shift

        root = forest(len(ids), links())
        met = np.flatnonzero(count)
        return pd.DataFrame({"c": ids[met], "links": count[met], "root": ids[root[met]]})

    return work


def _units(rows: DataFrame, visits: DataFrame, q: Quantiser, params: PQParams) -> DataFrame:
    """Rows of all units of work: each pair of blocks of a list, and each block with each block of visitors."""
    sizes = {}
    for side, df in enumerate((rows, visits)):
        for r in df.groupBy("list").count().collect():  # one row a list
            sizes.setdefault(r["list"], [0, 0])[side] = r["count"]
    spark = rows.sparkSession
    plan = spark.createDataFrame(
        [(k, max(1, ceil(m / params.block)), ceil(v / params.block)) for k, (m, v) in sizes.items() if m], "list int, nm int, nv int"
    )
    block = lambda n: F.pmod(F.xxhash64("c", F.lit("block")), F.col(n)).cast("int")
    keep = ["list", "c", "n", "v", "codes", "error"]
    mine = rows.join(plan, "list").withColumn("block", block("nm"))
    own = mine.select(
        *keep, "block", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("other")
    ).select(
        *keep, F.lit("m").alias("kind"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("block") == F.col("other")).alias("alone"),
    )
    hosts = mine.where("nv > 0").select(*keep, F.lit("v").alias("kind"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("y"), F.lit(0).alias("side"), F.lit(False).alias("alone"))
    guests = visits.join(plan, "list").withColumn("y", block("nv")).select(*keep, F.lit("v").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("x"), "y", F.lit(1).alias("side"), F.lit(False).alias("alone"))
    everyone = own.unionByName(hosts).unionByName(guests)
    return everyone.groupBy("list", "kind", "x", "y").applyInPandas(_unit(q, params.similarity), "c long, links long, root long")


def near_duplicates(vectors: DataFrame, params: PQParams = PQParams(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, n_links, component)`` for every row.

    ``n_links`` counts the other rows with a cosine of at least ``similarity``, equal vectors included; ``component`` is the least
    id reachable by links, the row's own included. Rows without a direction (null, empty or zero vectors, null or non-finite
    components) link with nothing, and neither do vectors of different lengths. Repeated ids are rows of their own.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"), usable(vector).alias("ok")), "vectors")
    classes = stored(
        rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()),
        "vector_classes",
    )
    found = []
    for size, n in classes.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("k")).collect():
        part = classes.where(F.size("v") == size).select("c", "n", "v")
        most = max(256, min(params.sample, params.sample_values // size))
        share = int(min(1.0, most / n) * 1_000_000)
        picked = part.where(F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1_000_000)) < share).select("v").toPandas().v
        if picked.empty:
            picked = part.select("v").limit(1).toPandas().v
        lists = max(1, min(params.most_lists, len(picked) // 8, n // params.vectors_per_list))
        q = Quantiser(picked, lists, params)
        schema = f"list int, c long, n long, v {part.schema['v'].dataType.simpleString()}, codes binary, error double"
        index = stored(part.mapInPandas(_members(q), schema), "index")
        visits = stored(part.mapInArrow(_visits(q), schema), "visits")
        found.append(stored(_units(index, visits, q, params), "vector_links"))
    links = found[0] if found else spark.createDataFrame([], "c long, links long, root long")
    for more in found[1:]:
        links = links.unionByName(more)
    degree = links.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("c != root"), "c", "root").withColumnsRenamed({"node": "c"})
    named = classes.select("c", "rep", "n").join(degree, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = stored(named.select("c", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector_degrees")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_class = named.join(least, "root").select("c", "n_links", "component")
    by_vector = stored(classes.select("v", "c").join(by_class, "c").drop("c"), "vector_components")
    linked = rows.where("ok").join(by_vector, "v").select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumnRenamed("id", id)
