import math

import numpy as np
import pytest

from coursepath.llm import embedding_pq as E

from .fixtures import plain


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[a].add(b)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((rows[i][0], len(links[i]), min(rows[k][0] for k in seen)))
    return sorted(out)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, c string, n int")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(25, 20))
    rows = [(k, (centers[k % 25] + rng.normal(size=20) * rng.choice([0.05, 0.15, 0.3])).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 - k, rows[0][1]) for k in range(30)]  # equal copies
    rows += [(2000, [x * 4 for x in rows[1][1]]), (2001, [-x for x in rows[1][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [None] + [1.0] * 19), (3004, [math.nan] * 20), (3005, [math.inf] + [0.0] * 19), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    small = E.PQParams(vectors_per_list=20, block=16, codes=8)
    for params in (small, E.PQParams()):
        assert plain(E.near_duplicates(table(spark, rows, kind), params), "vec_id", "n_links", "component") == sorted(brute(rows), key=str)


def test_repeated_ids_and_empty_tables(spark):
    assert E.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)]
    assert plain(E.near_duplicates(table(spark, rows)), "vec_id", "n_links", "component") == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_probes_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12))
    x[200:] = x[:200] + rng.normal(size=(200, 12)) * 0.08
    q = E.Quantiser(x, 30, E.PQParams())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own, near = q.nearest(u), (u @ u.T) >= 0.95
    flags = q.probes(u, own)
    pairs = [(a, b) for a, b in zip(*np.nonzero(near)) if own[a] < own[b]]
    assert pairs and all(flags[a, own[b]] for a, b in pairs)
    codes, left = q.encode(u - q.centers[own])
    assert codes.dtype == np.uint8 and (left >= 0).all()


def test_extreme_finite_vectors_link_like_any_other(spark):
    """Squares that under- or overflow a double poison neither their own links nor those of others."""
    rng = np.random.default_rng(4)
    rows = [(k, (v := rng.normal(size=2).tolist())) for k in range(60)] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [1e-200, 2e-200]), (103, [1e200, 2e200])]
    rows += [(104, [5e-324, 1e-323]), (105, [1e308, -1e308]), (106, [-1e-308, 1e-308]), (107, [1.7e308, 0.0]), (108, [0.0, 5e-324])]
    plain_rows = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    for params in (E.PQParams(vectors_per_list=10, block=8, codes=4), E.PQParams()):
        got = plain(E.near_duplicates(table(spark, rows, "double"), params), "vec_id", "n_links", "component")
        assert got == sorted(brute(plain_rows), key=str)


def test_a_cosine_of_exactly_the_similarity_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.6 - 1e-9, 0.8])]
    got = plain(E.near_duplicates(table(spark, rows, "double"), E.PQParams(similarity=0.6)), "vec_id", "n_links", "component")
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1)]
