import random

import pytest

from coursepath.llm import toxicity as T

from .fixtures import documents, prose

PARAMS = T.ToxicityParams(trees=8, depth=3)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(500):
        words, bad = prose(rng, 60).split(), i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["nastyone", "nastytwo", "vileword"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    texts += [(900, None), (901, ""), (None, "vileword nastyone you"), (0, texts[0][1]), (902, "a " * 50_000)]
    learn = [x for x in labels if x[0] % 5] + [(None, 1, 1), (1, 1, None), (2, 1, 0)]
    lab = spark.createDataFrame(learn, "doc_id long, quality int, toxic int")
    out = T.score_toxicity(documents(spark, texts), lab, PARAMS, score="tox")
    return out, {i: t for i, _, t in labels}


def test_held_out_documents_are_told_apart(scored):
    out, truth = scored
    rows = [r for r in out.collect() if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 5 == 0]
    assert len(rows) >= 100
    assert sum((r.tox >= 0.5) == bool(truth[r.doc_id]) for r in rows) / len(rows) > 0.95


def test_every_row_and_column_stays_and_scores_are_chances(scored):
    out, _ = scored
    assert out.columns[-1] == "tox" and "features" in out.columns and out.columns.count("score") == 1
    rows = out.collect()
    assert len(rows) == 505 and all(0 <= r.tox <= 1 for r in rows)


def test_without_labels_the_score_is_the_smoothed_share(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.tox for r in T.score_toxicity(docs, none, score="tox").collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.score_toxicity(docs, one, score="tox").first().tox == pytest.approx(1 / 3)
    assert T.score_toxicity(docs.limit(0), one, score="tox").count() == 0


def test_features():
    starts = frozenset(["idio"])
    f = dict(zip(T.FEATURES, T.features_of("YOU idiot!! you i d i o t", {"idiot": 2.0}, starts)))
    assert f["near_you"] > 0 and f["shouts"] > 0 and f["spaced_words"] > 0 and f["unmasked_hits"] > 0
    assert dict(zip(T.FEATURES, T.features_of("an id10t", {"idiot": 2.0}, starts)))["masked_words"] > 0
    assert T.features_of("", {}, starts) == [0.0] * len(T.FEATURES)
    assert T._stretched("sooooo 11111") == 1
