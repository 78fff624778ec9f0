import random

import pytest

import corpus_pipeline as C
from coursepath.llm import simhash_trie

from .fixtures import documents, prose


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        for _ in range(3 * bad):
            words[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo"])
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    item = prose(rng, 30)
    texts += [(400, texts[1][1]), (401, texts[2][1].upper()), (402, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (403, "mail jo.98@mail5.example.com"), (404, ""), (None, None), (405, texts[3][1]), (405, texts[3][1])]
    d = str(tmp_path_factory.mktemp("sf"))
    documents(spark, texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts


def test_stages_one_by_one(spark, sf, tmp_path):
    d, texts = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        if k < len(C.STAGES) - 1:
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert sum(i % 4 == 0 for i in ids(after) if i is not None and i < 300) <= 4
    assert len([i for i in ids(after) if i is not None and i < 300 and i % 4]) >= 220
    before, after = seen["simhash_near_dedup"]
    groups = simhash_trie.simhash_groups(before).collect()
    assert ids(after) == {r.component for r in groups} and after.count() == len({r.component for r in groups})
    assert not ids(after) & {400, 401, 405, None}
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {402}
    before, after = seen["pii_surrogates"]
    new = {r.doc_id: r.text for r in after.collect()}
    assert "jo.98" not in new[403] and all(new[r.doc_id] == r.text for r in before.collect() if r.doc_id != 403)
    before, after = seen["packing"]
    assert after.count() == before.count() and "batch" in after.columns


def test_run_equals_its_stages(spark, sf):
    d, _ = sf
    out = C.run(spark, d)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 150 < out.count() < 300


def brute_groups(texts):
    """Groups of row numbers whose fingerprints link, pair by pair."""
    prints = [simhash_trie.fingerprint_of(t or "") & (2**64 - 1) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group, prints


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    """Near copies under one id, ids that repeat over groups, rows without an id, and equal rows."""
    rng = random.Random(2)
    a, b, c = (prose(rng, 200) for _ in range(3))
    near = " ".join(["changed", *a.split()[1:]])
    texts = [(1, a), (1, near), (2, a), (5, b), (5, c), (5, c), (3, b), (None, c), (None, "only without id " * 9), (None, "only without id " * 9), (7, None), (8, "")]
    texts += [(9, prose(rng, 30)), (9, prose(rng, 30))]
    group, prints = brute_groups(texts)
    assert len({group[0], group[1], group[2]}) == 1
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = []
    for g in set(group):
        members = [k for k in range(len(texts)) if group[k] == g]
        k = min(members, key=lambda k: (texts[k][0] is None, texts[k][0] or 0, signed[k]))
        want.append((texts[k][0], signed[k]))
    kept = C.drop_near_duplicates(spark, documents(spark, texts), "")
    assert kept.columns == documents(spark, []).columns
    got = [(r.doc_id, simhash_trie.fingerprint_of(r.text or "")) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES][0] == "toxicity"
