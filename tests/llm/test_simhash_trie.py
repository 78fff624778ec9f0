import random

import numpy as np
import xxhash

from coursepath.llm import simhash_trie as S
from coursepath.llm.components import connected_components, forest

from .fixtures import documents, prose


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def slow_components(ids, fps):
    label = {k: k for k in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for k, root in label.items():
        if ids[k] is not None:
            least[root] = min(least.get(root, 1 << 60), ids[k])
    return [least.get(label[k]) for k in range(len(ids))]


def test_fingerprint_of_odd_texts():
    for text in ("", "  \n", "One", "one  two", "A b C d", "ÄÖ über das x", "a a a a a a a"):
        assert S.fingerprint_of(text) % (1 << 64) == slow_fingerprint(text)
    assert S.fingerprint_of("x y z " * 40_000) % (1 << 64) == slow_fingerprint("x y z " * 40_000)


def test_links_of_a_trie_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for _ in range(4)]
    a = np.unique(np.concatenate([base, *near]))
    got = {(int(i), int(j)) for x, y in S.linked(a, None) for i, j in zip(x, y)}
    assert got == {(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3) if i < j}
    assert list(S.linked(a[:0], None)) == []
    assert forest(3, iter([(np.array([2]), np.array([1]))])).tolist() == [0, 1, 1]


def test_groups_equal_brute_force_at_any_leaf_size(spark):
    rng = random.Random(4)
    texts = []
    for k in range(40):
        words = prose(rng, 120).split()
        for copy in range(3):
            changed = words[:]
            changed[rng.randrange(120)] = f"x{copy}"
            texts.append((1000 - len(texts), " ".join(changed)))
    texts += [(7, None), (8, ""), (9, " "), (None, "alone one two"), (3, texts[0][1]), (3, texts[0][1])]
    df = documents(spark, texts)
    ids, fps = [i for i, _ in texts], [slow_fingerprint(t or "") for _, t in texts]
    want = sorted(zip(ids, fps, slow_components(ids, fps)), key=str)
    for leaf in (None, 8):
        rows = S.simhash_groups(df, leaf=leaf).collect()
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component) for r in rows), key=str) == want


def test_crowded_prefix_is_split_deeper(spark):
    rng = random.Random(5)
    fps = {(0x2BCDEF << 40) | rng.getrandbits(30) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = S.fingerprint_links(df, leaf=16)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    order = sorted(fps)
    a = np.array(order, np.uint64)
    root = forest(len(a), S.linked(a, None))
    want = {order[i]: order[root[i]] for i in range(len(a)) if (root == root[i]).sum() > 1}
    assert roots == want


def test_no_documents(spark):
    assert S.simhash_groups(documents(spark, [])).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    loops = spark.createDataFrame([(1, 1), (None, 2), (4, 3), (3, 4), (5, 4)], "a long, b long")
    assert sorted(map(tuple, connected_components(loops).collect())) == [(3, 3), (4, 3), (5, 3)]
