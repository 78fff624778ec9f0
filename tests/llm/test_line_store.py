import hashlib
import random

import numpy as np
import pytest

from coursepath.llm.cuckoo import CuckooFilter
from coursepath.llm.line_store import LineStore
from coursepath.llm.queries import op11_line_store

from .fixtures import documents

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(docs):
    """(id, n_lines, n_dropped, kept) by a dictionary of all lines."""
    holders = {}
    place = lambda i: (i is None, i or 0)
    for id_, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(place(id_))
    out = []
    for id_, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == place(id_)]
        out.append((id_, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, ids):
    rng = random.Random(seed)
    pool = [f"  Shared line number {i % 40}\t" if i % 3 else f"short {i % 7}" for i in range(60)] + ["ÄÖÜäöüßéèê", "äöüÄÖÜßéèê", "exactly 10", "\r", "tab\tinside a line"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line of {i} {rng.random()}" for _ in range(rng.randrange(1, 12)))) for i in ids]


ODD = [
    (1, None), (2, ""), (3, "\n\n"), (4, "the same line\nthe same line"), (5, "THE SAME LINE \n the same line\nother"), (None, "the same line\nnull only line"),
    (None, "null only line"), (6, "a" * 200_000 + "\nthe same line"), (6, "twice under one id"), (6, "twice under one id\nthe same line"), (7, "nbsp line "), (8, "nbsp line"),
]


def test_filter_never_denies_and_forgets_what_is_removed():
    rng = np.random.default_rng(5)
    for n in (2, 50, 20_000):
        keys, others = (rng.integers(-(2**63), 2**63 - 1, m) for m in (n, 50_000))
        made = CuckooFilter.read(CuckooFilter.of(keys).written())
        assert made.holds(keys).all() and made.holds(others).mean() < 1e-3
        made.remove(keys[: n // 2])
        assert made.holds(keys[n // 2 :]).all() and made.holds(keys[: n // 2]).mean() < 0.05
        made.insert(keys[: n // 2])
        made.remove(keys)
        assert not made.table.any()


def test_a_filter_that_overflows_holds_everything():
    made = CuckooFilter.sized(1)
    made.insert(np.arange(500))
    assert made.holds(np.arange(10_000)).all()
    assert CuckooFilter.read(made.written()).holds(np.arange(9)).all()


@pytest.mark.parametrize("docs", [ODD, corpus(1, range(60)), ODD + corpus(2, range(10, 40)), []])
def test_one_batch_equals_brute_force(spark, tmp_path, docs):
    store = LineStore(spark, str(tmp_path / "s"), shards=8)
    table = documents(spark, docs)
    store.insert(table)
    assert rows(store.deduplicated(table)) == brute(docs)


def references(store):
    return sorted(tuple(r) for r in store.references().select("k1", "k2", "n_docs", "owner").collect())


def test_batches_and_deletions_equal_one_batch_of_what_is_left(spark, tmp_path):
    docs = corpus(3, range(80)) + [d for d in ODD if d[0] is None]
    store = LineStore(spark, str(tmp_path / "s"), shards=8)
    for part in (docs[50:], docs[:30], docs[30:50]):
        store.insert(documents(spark, part))
    assert rows(store.deduplicated(documents(spark, docs))) == brute(docs)
    gone = set(range(0, 80, 3)) | {None}
    store = LineStore(spark, str(tmp_path / "s"))  # as another session opens it
    assert (store.version, store.shards) == (3, 8)
    store.delete(documents(spark, [(i, "") for i in [*gone, 1000, 0]]))
    left = [d for d in docs if d[0] not in gone]
    assert rows(store.deduplicated(documents(spark, left))) == brute(left)
    fresh = LineStore(spark, str(tmp_path / "fresh"), shards=8)
    fresh.insert(documents(spark, left))
    assert references(store) == references(fresh)
    back = [d for d in docs if d[0] in gone]
    store.insert(documents(spark, back))
    assert rows(store.deduplicated(documents(spark, docs))) == brute(docs)
    # The filters hold exactly the keys of the exact table.
    held = {r.shard: CuckooFilter.read(bytes(r.held)) for r in store._filters().collect()}
    for r in store.references().collect():
        assert held[r.shard].holds(np.array([r.k2]))[0]
    assert sum(r.n_held for r in store._filters().collect()) == store.references().count()
    store.delete(documents(spark, [(d[0], "") for d in docs]))
    assert store.references().count() == 0 and store.deduplicated(documents(spark, docs)).agg({"n_dropped": "sum"}).first()[0] == 0
    assert not any(CuckooFilter.read(bytes(r.held)).table.any() for r in store._filters().collect())


def test_an_unfinished_version_counts_for_nothing(spark, tmp_path):
    docs = corpus(4, range(20))
    store = LineStore(spark, str(tmp_path / "s"), shards=4)
    store.insert(documents(spark, docs))
    store._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.insert(documents(spark, corpus(5, range(20, 40))))
    again = LineStore(spark, str(tmp_path / "s"))
    assert again.version == 1 and rows(again.deduplicated(documents(spark, docs))) == brute(docs)
    more = corpus(6, range(20, 40))
    again.insert(documents(spark, more))
    assert rows(again.deduplicated(documents(spark, docs + more))) == brute(docs + more)


def test_lines_are_looked_up_without_filters_when_these_are_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("coursepath.llm.line_store._FILTER_BYTES", 0)
    docs = corpus(7, range(30))
    store = LineStore(spark, str(tmp_path / "s"), shards=4)
    store.insert(documents(spark, docs))
    assert rows(store.deduplicated(documents(spark, docs))) == brute(docs)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in brute(docs)]
    assert rows(op11_line_store(spark, sf_dir)) == sorted(want, key=str)
