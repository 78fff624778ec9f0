import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coursepath.llm import masked_lm as M

from .fixtures import documents

SMALL = M.MaskedLmParams(side=4, batch=256, rate=0.1, tokens_per_shard=4_000)


def pairs(rng, n=300):
    """Texts in which each word tells its neighbour."""
    return [(i, " ".join(f"{(a := rng.choice('abcdef'))}one {a}two" for _ in range(40))) for i in range(n)]


@pytest.fixture(scope="module")
def case(spark):
    texts = pairs(random.Random(1))
    docs = documents(spark, texts)
    even = M.MaskedLmParams(side=4, rounds=0)
    return texts, docs, M.train_masked_lm(docs, SMALL)[0], M.train_masked_lm(docs, even)[0]


def slow_score(model, counts, text):
    """Word by word: network, class and share, without the library's batches and tables."""
    v, net = model.vocabulary, model.network
    words = re.findall(r"[^\W_]+", text.lower())
    of = lambda w: int(v.classes[v.number[w]]) if w in v.number else v.own + M._ending(w, v.shared)
    ids = [v.size] * 2 + [of(w) for w in words] + [v.size] * 2
    total = 0.0
    for i, w in enumerate(words, start=2):
        h = np.tanh(net.bias + net.around[0][ids[i - 2]] + net.around[1][ids[i - 1]] + net.around[2][ids[i + 1]] + net.around[3][ids[i + 2]])
        group, place = divmod(ids[i], v.side)
        for z, k in ((h @ net.out1 + net.even1, group), (h @ net.out2[group] + net.even2[group], place)):
            total += float(z[k] - np.log(np.exp(z.astype(float)).sum()))
        if ids[i] >= v.own:
            total += np.log(max(1, counts[w]) / (sum(n for x, n in counts.items() if of(x) == ids[i]) + 1))
    return total


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_scores_are_sums_of_conditional_log_probabilities(spark, hot):
    rng = random.Random(2)
    corpus = pairs(rng, 40) + [(100 + k, " ".join(f"rare{rng.randrange(60)}" for _ in range(20))) for k in range(20)]
    counts = Counter(w for _, t in corpus for w in t.split())
    model, _ = M.train_masked_lm(documents(spark, corpus), M.MaskedLmParams(side=5, batch=64, hot=hot))
    texts = [(1, "aone atwo bone"), (2, "Zzz! aone, q_rare7"), (3, None), (4, ""), (5, "!!"), (None, "aone"), (1, "aone atwo bone"), (6, "rare1 rare59 never aone " * 5000)]
    rows = M.score_documents(documents(spark, texts), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = dict(texts[:5] + [(None, "aone"), (6, "rare1 rare59 never aone " * 5000)])[r.doc_id]
        words = re.findall(r"[^\W_]+", (text or "").lower())
        assert r.n_tokens == len(words)
        if not words:
            assert (r.log_likelihood, r.per_token) == (0.0, None)
        elif r.doc_id != 6:
            assert r.log_likelihood == pytest.approx(slow_score(model, counts, text), abs=1e-3)
            assert r.per_token == pytest.approx(r.log_likelihood / r.n_tokens)


def test_training_learns_from_both_sides(spark, case):
    _, docs, model, even = case
    mean = lambda m: M.score_documents(docs, m).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    assert mean(model) > mean(even) + 0.3
    shuffled = documents(spark, [(1, "aone btwo cone dtwo eone ftwo"), (2, "aone atwo bone btwo cone ctwo")])
    got = {r.doc_id: r.per_token for r in M.score_documents(shuffled, model).collect()}
    assert got[2] > got[1] + 0.3


def test_words_far_down_the_list_are_told_apart_by_their_neighbours(spark):
    """Six hundred words that are equally frequent, in pairs: each word's partner is likelier beside it than another's."""
    rng = random.Random(3)
    texts = [(i, " ".join(f"l{(k := rng.randrange(300))}q r{k}q" for _ in range(60))) for i in range(1500)]
    model, _ = M.train_masked_lm(documents(spark, texts), M.MaskedLmParams(side=36, rounds=4, batch=128, rate=0.3))
    assert model.vocabulary.own >= 600
    right = [(k, f"l{k}q r{k}q") for k in range(200, 260)]
    wrong = [(1000 + k, f"l{k}q r{(k + 17) % 300}q") for k in range(200, 260)]
    got = {r.doc_id: r.per_token for r in M.score_documents(documents(spark, right + wrong), model).collect()}
    assert np.mean([got[k] > got[1000 + k] for k in range(200, 260)]) > 0.9


def test_files_and_tasks_do_not_decide_the_result(spark, case):
    texts, _, model, _ = case
    turned = documents(spark, texts[::-1]).repartition(3)
    again, _ = M.train_masked_lm(turned, SMALL)
    assert int(sum(model.vocabulary.totals)) // SMALL.tokens_per_shard == 6
    for a, b in zip(model.network.parts, again.network.parts):
        np.testing.assert_allclose(a, b, atol=1e-4)


def test_classes_grow_with_the_words(spark):
    for n, side in ((10, 4), (1000, 6), (40_000, 15)):
        docs = documents(spark, [(1, " ".join(f"w{k}" for k in range(n)))])
        assert M.train_masked_lm(docs, M.MaskedLmParams(rounds=0))[0].vocabulary.side == side


def test_no_documents(spark):
    empty = documents(spark, [])
    model, encoded = M.train_masked_lm(empty)
    assert M.score_encoded(encoded, model).count() == 0 and M.score_documents(empty, model).count() == 0
    one = M.score_documents(documents(spark, [(1, "x y")]), model).first()
    assert one.per_token == pytest.approx(-np.log(model.vocabulary.size), abs=1e-5)


def test_every_position_is_trained_on_once():
    for rounds in (1, 2, 3):
        for n in (1, 2, 5, 1000):
            assert (sum(((np.arange(n) + k) % rounds == 0).astype(int) for k in range(rounds)) == 1).all()


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_rare_words_keep_their_own_probability(spark, hot):
    texts = [(1, "the the the the xing xing xing ying"), (2, "the zing the ying")]
    model, _ = M.train_masked_lm(documents(spark, texts), M.MaskedLmParams(side=1, rounds=0, hot=hot))  # one class holds all words
    assert model.vocabulary.own == 0 and model.vocabulary.totals.tolist() == [12]
    ask = [(1, "xing"), (2, "zing"), (3, "never seen"), (4, "the"), (5, "xing ying")]
    got = {r.doc_id: r.log_likelihood for r in M.score_documents(documents(spark, ask), model).collect()}
    log = lambda *n: sum(np.log(k / 13) for k in n)
    assert got == pytest.approx({1: log(3), 2: log(1), 3: log(1, 1), 4: log(6), 5: log(3, 2)}, abs=1e-5)


def test_words_are_those_of_the_pattern():
    everything = "".join(map(chr, range(0x110000)))
    odd = ["".join(f"{c}a" for c in everything), "ΑΣ. ΑΣ İx", "naïve «été»—42 a_b\u00a0c\u2003d\x1ce\x00f", "", " _ ", "\ud800x", "日本 語。"]
    for text in [everything, *odd]:
        assert M.words_of(text) == re.findall(r"[^\W_]+", text.lower())


def test_only_texts_with_marks_beyond_ascii_need_the_pattern(monkeypatch):
    class Refused:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(M, "_WORD", Refused())
    assert M.words_of("Ça, c'est l'été: A_1\tÖl.\n") == ["ça", "c", "est", "l", "été", "a", "1", "öl"]
    with pytest.raises(AssertionError):
        M.words_of("«x»")


def test_each_word_is_looked_up_once():
    class Counted(dict):
        seen = 0

        def get(self, *key):
            self.seen += 1
            return super().get(*key)

        def __contains__(self, key):
            self.seen += 1
            return super().__contains__(key)

    number = Counted(a=0, bees=1)
    vocabulary = M.Vocabulary(2, 1, number, np.array([0, 3]), np.array([0.0, -1.5]), np.zeros(4, np.int64))
    texts = [["a", "bees", "xing", "a"], [], ["xing", "bees", "ying"]]
    classes, shares, others = vocabulary.encode(texts)
    ending = {w: 1 + M._ending(w, 3) for w in ("xing", "ying")}
    assert classes.tolist() == [0, 3, ending["xing"], 0, ending["xing"], 3, ending["ying"]]
    assert shares.tolist() == [-1.5, 0, -1.5] and others == [["xing"], [], ["xing", "ying"]]
    assert number.seen == 7


def test_a_class_number_is_stored_in_two_bytes_and_words_in_one_table(spark, monkeypatch):
    names, stored = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: names.append(name) or stored(df, name))
    texts = [(1, "a b c b"), (2, ""), (3, None), (4, "c d")]
    model, encoded = M.train_masked_lm(documents(spark, texts), SMALL)
    assert names == ["word_counts", "encoded"]
    got = {r.id: np.frombuffer(r.packed, np.uint16).tolist() for r in encoded.collect()}
    of = lambda w: int(model.vocabulary.classes[model.vocabulary.number[w]])
    assert got == {k: [of(w) for w in (t or "").split()] for k, t in texts}


@pytest.mark.parametrize("kind", [np.uint16, np.int32])
def test_lists_of_numbers_survive_their_bytes(kind):
    lists = [[1, 2], [], [65_535], [7, 8, 9], []]
    packed = pa.array([np.array(x, kind).tobytes() for x in lists], pa.binary())
    for x in range(len(lists) + 1):
        for y in range(x, len(lists) + 1):
            ids, at, sizes = M._stream(packed.slice(x, y - x), 70_000, kind)
            assert sizes.tolist() == [len(v) for v in lists[x:y]] and ids[at].tolist() == sum(lists[x:y], [])
            assert len(ids) == sum(map(len, lists[x:y])) + 2 * (y - x + 1) and (np.delete(ids, at) == 70_000).all()


def test_large_vocabularies_have_wider_numbers():
    of = lambda side: M.Vocabulary(side, 0, {}, np.empty(0), np.empty(0), np.empty(0)).kind
    assert (of(255), of(256)) == (np.uint16, np.int32)
