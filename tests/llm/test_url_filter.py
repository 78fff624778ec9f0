import math
import random
from collections import Counter, defaultdict

from coursepath.llm import url_filter as U
from coursepath.llm.queries import URL_RULES

from .fixtures import plain


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "s", 1.0, "g") for i, u in enumerate(urls)], "page_id long, url string, html string, s string, score double, g string")


def test_parts_and_rules(spark):
    urls = [
        "https://A.B.Example.ORG/es/x?q#f", "http://example.org", "http://example.org/", "http://notexample.org/en/1", "ftp://example.org/en/12?x", "http://x.com/fr/", "http://x.com/fr?",
        "no-scheme/path", None, "", "http://", "http://h?q=/fr/", "HTTP://É.com/de/ü",
    ]
    got = [(r.host, r.path, r.rule, r.verdict if r.rule else None) for r in U.judge_urls(pages(spark, urls), URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.b.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "", None, None), ("example.org", "/", "org/", "allow"), ("notexample.org", "/en/1", "org/", "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/fr", None, None),
        ("", "", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("h", "", None, None), ("É.com", "/de/ü", "com/de/", "block"),
    ]


def slow_models(texts):
    """Witten-Bell interpolation by the book, from texts of one class."""
    n, kinds = [Counter() for _ in range(4)], defaultdict(set)
    seen = Counter()
    for s in texts:
        for i in range(3, len(s)):
            for o in range(4):
                n[o][s[i - o : i + 1]] += 1
                seen[s[i - o : i], o] += 1
                kinds[s[i - o : i], o].add(s[i])

    def p(run, o):
        c = run[3 - o : 3]
        if o == 0:
            return (n[0][run[3]] + 1) / (seen["", 0] + U.ALPHABET)
        low = p(run, o - 1)
        t = len(kinds[c, o])
        return (n[o][run[3 - o :]] + t * low) / (seen[c, o] + t) if seen[c, o] else low

    return lambda run: math.log(p(run, 3))


def test_model_equals_the_formula(spark):
    rng = random.Random(1)
    words = ["^^^" + "".join(rng.choice("abc/") for _ in range(rng.randint(0, 12))) + "$" for _ in range(80)]
    runs = U._runs(spark.createDataFrame([(w,) for w in words], "s string")).groupBy("g").count().withColumnRenamed("count", "n")
    slow = slow_models(words)
    got = {r.g: r.lp for r in U._model(runs, "n").collect()}
    assert got and all(math.isclose(got[g], slow(g), rel_tol=1e-9) for g in got)


def test_unlike_urls_are_told_apart(spark):
    rng = random.Random(2)
    good = [f"http://a{k}.site.org/{rng.choice(['news', 'blog'])}/{rng.randrange(999)}" for k in range(150)]
    bad = [f"http://b{k}.site.com/de/{rng.choice(['casino', 'pills'])}-{rng.randrange(999)}" for k in range(150)]
    new = ["http://n.site.net/news/5", "http://n.site.net/blog/77", "http://n.site.net/casino-7", "http://n.site.net/pills-41"]
    out = U.judge_urls(pages(spark, good + bad + new), URL_RULES).where("rule is null").orderBy("page_id")
    assert [r.verdict for r in out.collect()] == ["allow", "allow", "block", "block"]


def test_no_rules_no_pages_and_repeats(spark):
    assert U.judge_urls(pages(spark, []), URL_RULES).count() == 0
    out = U.judge_urls(pages(spark, ["http://a.org/", "http://a.org/", None]), [])
    assert plain(out, "rule", "verdict") == [(None, "allow")] * 3
