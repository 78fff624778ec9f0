import random
import re
from collections import Counter

import pytest

from coursepath.llm import decontamination as D

from .fixtures import documents, plain, prose


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w, size=5):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def similarity(a, b):
    """By shingles of five words; an item of fewer is one shingle."""
    size = min(5, len(b))
    x, y = bag(a, size), bag(b, size)
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common) if x and y else 0.0


def brute(texts, items):
    """All windows of an item's size that match it."""
    out = {}
    for i, t in texts:
        w = words(t)
        for k, item in items:
            v = words(item)
            if not v:
                continue
            starts = range(max(1, len(w) - len(v) + 1))
            best = max(similarity(w[s : s + len(v)], v) for s in starts)
            if best >= 0.8:
                out[i, k] = max(best, out.get((i, k), 0))
    return {(i, k, round(v, 9)) for (i, k), v in out.items()}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randint(15, 60))) for k in range(12)]
    items += [(50, items[0][1].upper()), (51, ""), (52, None)]
    texts = []
    for i in range(60):
        w = prose(rng, rng.randint(0, 200)).split()
        if i % 2:
            v = rng.choice(items[:12])[1].split()
            if i % 4 == 1:  # cut at an end or with one word changed
                v = v[rng.randint(0, 3) :]
            if i % 8 == 1:
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [f"{x}***" if i % 3 else x for x in v]
        texts.append((i, " ".join(w)))
    texts += [(70, None), (71, ""), (None, items[3][1]), (72, items[4][1][:-4]), (73, (items[5][1] + "! ") * 40), (5, texts[5][1])]
    return texts, items


def test_matches_equal_brute_force(spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.contaminated(documents(spark, texts), bench)
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in found.collect()}
    want = brute(texts, items)
    assert len(want) > 20 and got == want
    left = D.decontaminate(documents(spark, texts), bench)
    bad = {i for i, _, _ in want}
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, _ in texts if i not in bad)
    assert left.columns == documents(spark, []).columns


def test_join_beyond_the_broadcast_bound_gives_the_same(spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    far = D.contaminated(documents(spark, texts), bench, D.DecontaminationParams(broadcast_rows=0))
    assert plain(far, "doc_id", "item_id") == sorted(((i, k) for i, k, _ in brute(texts, items)), key=str)


def test_short_items_are_found_where_their_words_stand_in_a_row(spark):
    items = [(1, "Yes, sir"), (2, ""), (3, "no"), (4, "one two three four"), (5, "a b c d e")]
    texts = [(1, "yes sir!"), (2, "oh yes, sir they said"), (3, None), (4, "yes my sir"), (5, "he said: No! and one two three  four"), (6, "one two four three"), (7, "z a b c d e z no")]
    found = D.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.similarity) for r in found.collect()} == brute(texts, items)
    assert {(r.doc_id, r.item_id): (r.start, r.n_words) for r in found.collect()}[2, 1] == (1, 2)


def mixed(rng, words):
    """The words with two stretches swapped, one moved, or some cut out, now and then below the similarity."""
    n, kind = len(words), rng.randrange(4)
    cut = rng.randrange(1, n)
    if kind == 0:
        return words[cut:] + words[:cut]
    if kind == 1:
        a, b = sorted(rng.sample(range(n), 2))
        return words[b:] + words[a:b] + words[:a]
    if kind == 2:
        return words[:cut] + [f"new{rng.randrange(9)}" for _ in range(rng.randrange(3))] + words[cut + rng.randrange(3) :]
    return words[rng.randrange(4) : n - rng.randrange(4)]


@pytest.mark.parametrize("vocabulary", [40, 5000])
def test_swapped_moved_and_cut_passages_equal_brute_force(spark, vocabulary):
    """Windows whose shingles stand elsewhere than in the item; few different words make shared shingles by chance too."""
    rng = random.Random(vocabulary)
    items = [(k, prose(rng, rng.randint(12, 70), vocabulary)) for k in range(25)]
    texts = [(i, " ".join(prose(rng, rng.randint(0, 60), vocabulary).split() + mixed(rng, rng.choice(items)[1].split()) + prose(rng, rng.randint(0, 60), vocabulary).split())) for i in range(150)]
    texts += [(200 + k, " ".join(t.split()[len(t.split()) // 2 :] + t.split()[: len(t.split()) // 2])) for k, t in items]
    found = D.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(texts, items)
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in found.collect()} == want and len(want) > 60


def test_empty_tables(spark, case):
    texts, items = case
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(documents(spark, texts), none).count() == 0
    assert D.decontaminate(documents(spark, texts), none).count() == len(texts)
    assert D.contaminated(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_stride_never_skips_a_match():
    for least in range(1, 40):
        k = D.safe_stride(least, least + 20, 0.8)
        for m in range(max(1, -(-8 * least // 10)), least + 21):
            assert m // k > int(m / 9 + 1e-9)


def test_multi_index_finds_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(63), 15))) for a in (rng.getrandbits(63) for _ in range(50))]
    left = D.blocks(spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k int, fp long"), 15)
    right = D.blocks(spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pairs)], "k int, fp long"), 15)
    assert left.join(right, ["k", "block", "bits"]).select("k").distinct().count() == 50


def test_cut_windows_just_at_the_similarity_are_all_found(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 59, 10**9)) for k in range(400)]
    texts = [(k, " ".join(t.split()[:48])) for k, t in items]  # 44 of 55 shingles: 0.8
    assert similarity(words(texts[0][1]), words(items[0][1])) == 0.8
    found = D.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert plain(found, "doc_id", "item_id") == sorted(((k, k) for k in range(400)), key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_clean_texts_under_a_contaminated_id_stay(spark, broadcast_rows):
    rng = random.Random(5)
    item, *clean = (prose(rng, 30) for _ in range(4))
    bad = f"{clean[0]} {item} {clean[1]}"
    docs = documents(spark, [(1, bad), (1, clean[0]), (1, clean[0]), (None, bad), (None, clean[1]), (None, None), (2, clean[2])])
    left = D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), D.DecontaminationParams(broadcast_rows=broadcast_rows))
    assert left.columns == docs.columns
    assert plain(left, "doc_id", "text") == sorted([(1, clean[0]), (1, clean[0]), (None, clean[1]), (None, None), (2, clean[2])], key=str)
