import random

from coursepath.llm import licenses as L

from .fixtures import documents, plain, prose


def brute(texts, least=0.85):
    out = {}
    for i, t in texts:
        body = (t or "").lower()
        parts = body.split("\n")
        import re

        parts += [p for p in re.split(r"\n\s*\n", body) if "\n" in p.strip(" ")]
        for p in parts:
            w = re.findall(r"[^\W_]+", p)
            a = set(zip(w, w[1:]))
            best = None
            for name, template in L.TEMPLATES:
                v = L._template_words(template)
                b = set(zip(v, v[1:]))
                d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if d >= least and (best is None or (-d, name) < best):
                    best = (-d, name)
            if best:
                d, n = out.get((i, best[1]), (0, 0))
                out[i, best[1]] = (max(d, -best[0]), n + 1)
    return sorted(((i, k, round(d, 9), n) for (i, k), (d, n) in out.items()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for i in range(80):
        lines = [prose(rng, rng.randint(0, 12)) for _ in range(5)]
        _, t = rng.choice(L.TEMPLATES)
        w = t.split()
        if i % 3 == 0 and len(w) > 6:
            w[rng.randrange(len(w))] = "other"
        if i % 5 == 0:
            w = [f"{x}***" for x in w]
        at = rng.randrange(5)
        lines[at:at] = ["", " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), ""] if i % 4 == 0 else [" ".join(w).upper()]
        texts.append((i, "\n".join(lines)))
    texts += [(90, None), (91, ""), (92, "license"), (3, texts[3][1]), (None, "Released under the MIT License."), (93, "Licensed under CC BY 4.0.\nReleased under the MIT License")]
    got = sorted(((r.doc_id, r.license, round(r.dice, 9), r.n_passages) for r in L.scan_licenses(documents(spark, texts)).collect()), key=str)
    want = brute(texts)
    assert len(want) > 40 and got == want


def test_every_match_holds_a_telling_word():
    rng = random.Random(2)
    words = set(L.telling_words(L.TEMPLATES, 0.85))
    for _, t in L.TEMPLATES:
        w = L._template_words(t)
        pairs = set(zip(w, w[1:]))
        for _ in range(50):
            gone = set(rng.sample(sorted(pairs), int(len(pairs) * 0.26)))
            if len(pairs - gone) >= 0.85 / 1.15 * len(pairs):
                assert any(words & set(p) for p in pairs - gone)


def test_no_documents(spark):
    assert plain(L.scan_licenses(documents(spark, [])), "doc_id") == []


def test_notices_inside_other_words_are_found(spark):
    rng = random.Random(3)
    by, mit, gpl = "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = [
        (1, f"Copyright 2020 Foo. {by} All rights reserved."),
        (2, prose(rng, 300) + " " + gpl + " " + prose(rng, 300)),
        (3, f"{by} {mit} {by}"),
        (4, f"{prose(rng, 9)} this work is licensed under the GNU\nGeneral Public License,\n\nversion 3 {prose(rng, 9)}"),
        (5, f"{mit}\n{prose(rng, 30)} {mit}"),
        (6, prose(rng, 200) + " license under the " + prose(rng, 50)),
        (7, prose(rng, 20) + " " + mit),
        (None, f"Copyright 2020 Foo. {by} All rights reserved."),
    ]
    got = plain(L.scan_licenses(documents(spark, texts + texts[:1])), "doc_id", "license", "dice", "n_passages")
    want = [(1, "CC-BY-NC-4.0", 1.0, 2), (2, "GPL-3.0", 1.0, 1), (3, "CC-BY-NC-4.0", 1.0, 2), (3, "MIT", 1.0, 1), (4, "GPL-3.0", 1.0, 1), (5, "MIT", 1.0, 2), (7, "MIT", 1.0, 1), (None, "CC-BY-NC-4.0", 1.0, 1)]
    assert got == sorted(want, key=str)
