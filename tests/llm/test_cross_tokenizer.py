import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from coursepath.llm import cross_tokenizer as C
from coursepath.llm.queries import op12_cross_tokenizer

from .fixtures import documents

A = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
B = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def pair():
    return C.Tokenizers(A, B)


def brute(docs):
    """Token by token and pair by pair, with the libraries themselves."""
    lib, sp = Tokenizer.from_str(A), sentencepiece.SentencePieceProcessor(model_proto=B)
    lib.encode_special_tokens = True
    bytes_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in bytes_} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in bytes_)}
    token_a = lambda i: bytes(chars[c] for c in lib.id_to_token(i))
    token_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    per_doc, counts = [], Counter()
    for id_, text in docs:
        sides = ([], [])
        if text:
            ids = lib.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            parts = [token_a(i) for i in ids[0]], [token_b(i) for i in ids[1]]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                for side, i, p in zip(sides, ids, parts):
                    at = 0
                    for token, piece in zip(i, p):
                        side.append((at, at + len(piece), token))
                        at += len(piece)
        a, b = sides
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, low, x, y = [], [], 0, 0, 0
        for cut in cuts:
            ga, gb = [], []
            while x < len(a) and a[x][1] <= cut:
                ga.append(a[x])
                x += 1
            while y < len(b) and b[y][1] <= cut:
                gb.append(b[y])
                y += 1
            groups.append(",".join(str(t[2]) for t in ga) + "|" + ",".join(str(t[2]) for t in gb))
            links += [(p[2], q[2]) for p in ga for q in gb if p[0] < q[1] and q[0] < p[1]]
        counts.update(links)
        per_doc.append((id_, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    return [
        (i, na, nb, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g)) for i, na, nb, g, k in per_doc
    ], counts, best


TEXTS = [
    (1, None), (2, ""), (3, "Hello world, this is tokenization."), (3, "Hello world, this is tokenization."), (4, "  two  spaces\n\n\ttabs   "), (5, "▁ is no space"),
    (6, "naïve café Ünïcödé 日本語テキスト 🙂🙂 ́‍"), (None, "no id"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "x" * 30_000), (9, "===== ==== === ==aaaaaaa aaa"), (10, " "),
    (11, "the cat sat on the mat " * 3000), (12, "a\u0000b\r\n\x1f"), (13, "12345 678.90 don't we'll I'VE"),
]


def test_equals_brute_force(spark, pair):
    found = C.align_tokenizers(documents(spark, TEXTS), pair)
    want, counts, best = brute(TEXTS)
    assert sorted(map(tuple, found.documents.collect()), key=str) == sorted(want, key=str)
    pairs = {(r.a, r.b): (r.n, r.best) for r in found.pairs.collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in counts.items()}
    assert any(r[3] == 0 for r in want) and any(r[4] > r[3] > 0 for r in want)


def test_rare_pairs_meet_their_counts_in_a_shuffle(spark, pair, monkeypatch):
    want = sorted(map(tuple, C.align_tokenizers(documents(spark, TEXTS), pair).documents.collect()), key=str)
    monkeypatch.setattr(C, "_HOT_PAIRS", 2)
    assert sorted(map(tuple, C.align_tokenizers(documents(spark, TEXTS), pair).documents.collect()), key=str) == want


def test_no_documents(spark, pair):
    found = C.align_tokenizers(documents(spark, []), pair)
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_identity_map_joins_the_same_bytes(pair):
    same = C.identity_map(pair.tokens_a, pair.tokens_b)
    assert (same >= 0).sum() > 5000
    assert all(pair.tokens_a[i] == pair.tokens_b[j] for i, j in enumerate(same) if j >= 0)


def test_the_quick_encoder_gives_the_librarys_ids(spark, pair, sf_dir):
    lib = Tokenizer.from_str(A)
    lib.encode_special_tokens = True
    texts = [" " + (t or "") for _, t in TEXTS] + [" " + (r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = pair.encoder_a()(texts)
    assert "tiktoken" in str(pair.encoder_a().__closure__[0].cell_contents.__class__.__module__)
    assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_another_json_is_encoded_by_its_library(pair):
    other = A.replace('"merges"', '"merges"', 1)
    import json

    spec = json.loads(other)
    spec["model"]["merges"] = spec["model"]["merges"][:1000][::-1]
    odd = C.Tokenizers(json.dumps(spec), B)
    assert [x.tolist() for x in odd.encoder_a()([" some text"])] == [Tokenizer.from_str(json.dumps(spec)).encode(" some text").ids]


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(docs)[0]]
    assert sorted(map(tuple, op12_cross_tokenizer(spark, sf_dir).collect())) == sorted(want)
