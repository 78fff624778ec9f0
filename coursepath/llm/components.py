"""Connected components of a link table, without collecting links or groups anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepath.llm.tables import stored


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position that each of ``n`` positions reaches through the links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            i, j = root[i], root[j]
            apart = i != j
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. ``edges`` have ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the least node of the component.

    Alternates the large-star and small-star steps until no link changes; every pass is stored, so a lost
    executor costs one pass at most. Self links and repeated links are allowed, links with a null are dropped.
    """
    links = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
        .where("not x and not y and u > v")
        .select("u", "v")
        .distinct(),
        "links",
    )
    mark = _mark(links)
    while mark[0]:
        links = stored(_small_star(_large_star(links)), "links")
        last, mark = mark, _mark(links)
        if last == mark:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
