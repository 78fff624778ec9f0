import hashlib
import random
import re
from zlib import crc32

import pytest

from coursepath.llm import periodic_runs as P
from coursepath.llm.queries import op13_periodic_runs, planted_period

from .fixtures import documents


def brute_runs(w):
    """Every period of every stretch, one period after the other."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    words, size = [], rng.choice([0, 5, 6, 30, 80, 200])
    while len(words) < size:
        if rng.random() < 0.5:
            part = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(1, 7))]
            if rng.random() < 0.5:
                part = part * rng.randrange(1, 6) + [rng.randrange(3)]
            words += part * rng.randrange(1, 8) + part[: rng.randrange(len(part) + 1)]
        else:
            words += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 12))]
    return words


def test_runs_are_those_of_every_period():
    rng = random.Random(3)
    for _ in range(1500):
        docs = [repetitive(rng) for _ in range(rng.choice([1, 4]))]
        want = [brute_runs(d) for d in docs]
        assert P.runs_of_texts([[str(x).encode() for x in d] for d in docs]) == want
        assert [P.diagonal_runs(d) for d in docs] == want


@pytest.mark.parametrize("words", [["a"] * 100_000, ["a", "b", "a"] * 20_000, (["a"] * 50 + ["b"]) * 400])
def test_long_repeats_are_quick(words):
    runs = P.runs_of_texts([[w.encode() for w in words]])[0]
    assert max(n for _, n, _ in runs) == len(words)


TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a a a a a a"),
    (4, "a a a a a a"),
    (5, "a a a a a"),
    (6, "x y x y x y x y x end"),
    (7, "a b a b a b a b a b a b"),
    (None, "q " * 30),
    (8, ("lorem ipsum dolor " * 5 + "sit\r\n") * 9),
    (9, " ".join(str(i % 571) for i in range(4_000))),
]


def test_texts_of_every_kind(spark):
    got = sorted(map(str, P.periodic_runs(documents(spark, TEXTS)).collect()))
    want = []
    for id_, text in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(words)
        want.append((id_, len(words), runs, brute_collapsed(words, runs)))
    rows = P.periodic_runs(documents(spark, TEXTS)).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in rows)
    assert len(got) == len(TEXTS)


def test_no_documents(spark):
    assert P.periodic_runs(documents(spark, [])).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert P.periodic_runs(documents(spark, [])).count() == 0


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words, runs)),
    )


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_row(d.doc_id, d.text) for d in docs if len((d.text or "").split()) < 5000)
    kept = {r[0] for r in want}
    got = sorted(tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect() if r.doc_id in kept)
    assert got == want
    assert len(want) >= 0.9 * len(docs) and any(r[1] for r in want)


def test_planting_leaves_null_ids_and_empty_texts_alone():
    planted = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    assert planted_period(None, [b"a", b"b"]) == [b"a", b"b"]
    assert planted_period(planted, []) == []
