"""URL filtering by rules, and by a character language-model ratio where no rule fits.

Two variable-order Markov models, one of URLs that a rule allows and one of URLs that a rule blocks, are counts of character
runs. Orders 0 to 3 are interpolated by Witten and Bell's rule: a context gives as much weight to the shorter context as
it has seen distinct characters. A URL is allowed if its log-likelihood difference per character reaches a threshold
calibrated on ruled URLs that neither model has seen. All of it is counts and joins of DataFrames.

The alphabet has 39 characters, so there are at most 39 ** 4 = 2.3 million runs of four and the model, 24 bytes a run, is
broadcast whatever the number of URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursepath.llm.tables import stored

# The characters of the model besides letters, digits (all as 0), start, end and other.
_MARKS = "./-_?=&%#"
ALPHABET = 26 + 1 + len(_MARKS) + 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CALIBRATION = "012"  # first hexadecimal digits of the MD5 of ruled URLs that calibrate: 3 of 16


@dataclass(frozen=True)
class UrlRule:
    action: str  # allow or block
    rule: str  # host and path, such as ``example.org/es/``

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, or null; a policy's rules are a short list that becomes one expression."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.rule) if out is None else out.when(fits, r.rule)
    return F.lit(None).cast("string") if out is None else out


def model_text(url: Column) -> Column:
    """What the models read: the URL without its scheme, letters in lower case, digits as 0, others as ``~``; padded."""
    body = F.when(F.instr(url, "://") > 0, _rest(url)).otherwise(url)
    body = F.translate(F.coalesce(body, F.lit("")), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.concat(F.lit("^^^"), F.regexp_replace(body, r"[^a-z0./\-_?=&%#]", "~"), F.lit("$"))


def _runs(df: DataFrame) -> DataFrame:
    """A row for each run of four characters; the fourth is the one to predict."""
    return df.withColumn("at", F.explode(F.expr("sequence(1, length(s) - 3)"))).withColumn("g", F.expr("substring(s, at, 4)"))


def _model(runs: DataFrame, n: str) -> DataFrame:
    """``(g, lp)``: the interpolated log-probability of each run's last character under the counts in column ``n``."""
    total = runs.agg(F.sum(n)).first()[0] or 0  # one number
    df = runs.select("g", F.col(n).alias("n"))
    last = F.substring("g", 4, 1)
    df = df.withColumn("p", (F.sum("n").over(Window.partitionBy(last)) + 1) / F.lit(float(total + ALPHABET)))
    for order in (1, 2, 3):
        context, run = F.substring("g", 4 - order, order), F.substring("g", 4 - order, order + 1)
        df = df.withColumn("run", run).withColumn("context", context)
        df = df.withColumn("k", F.sum("n").over(Window.partitionBy("run")))
        df = df.withColumn("seen", F.sum("n").over(Window.partitionBy("context")))
        kinds = df.where("k > 0").groupBy("context").agg(F.countDistinct("run").alias("kinds"))
        df = df.join(kinds, "context", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
        df = df.withColumn("p", F.when(F.col("seen") > 0, (F.col("k") + F.col("kinds") * F.col("p")) / (F.col("seen") + F.col("kinds"))).otherwise(F.col("p")))
        df = df.select("g", "n", "p")
    return df.select("g", F.log("p").alias("lp"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], id: str = "page_id", url: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row.

    The verdict is the rule's where one fits, else the models' (``allow`` or ``block``). A null or empty URL fits no rule and is
    judged by the models as an empty text. Repeated URLs count as often as they occur and are scored once. Without ruled
    URLs of both kinds the ratio is 0 or one-sided, and the threshold is 0: the verdict is then ``allow`` at a ratio of 0 or more.
    """
    u = F.col("url")
    known = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"))
    known = known.withColumn("host", host_of(u)).withColumn("path", path_of(u)).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    action = F.lit(None).cast("string")
    for r in rules:
        action = F.when(F.col("rule") == r.rule, r.action).otherwise(action)
    known = known.withColumn("action", action)
    held = F.substring(F.md5(F.coalesce(u, F.lit(""))), 1, 1).isin(*_CALIBRATION)
    texts = stored(
        known.groupBy(model_text(u).alias("s"), "action", F.coalesce(held, F.lit(False)).alias("held")).agg(F.count("*").alias("n")), "url_texts"
    )
    learn = F.col("n") * (~F.col("held")).cast("int")
    runs = stored(
        _runs(texts).groupBy("g").agg(
            F.sum(F.when(F.col("action") == "allow", learn).otherwise(0)).alias("allow"),
            F.sum(F.when(F.col("action") == "block", learn).otherwise(0)).alias("block"),
        ),
        "url_runs",
    )  # at most ALPHABET ** 4 rows
    model = stored(
        _model(runs, "allow").withColumnRenamed("lp", "a").join(_model(runs, "block").withColumnRenamed("lp", "b"), "g").select("g", (F.col("a") - F.col("b")).alias("d")),
        "url_model",
    )
    scores = stored(
        _runs(texts.select("s").distinct()).join(F.broadcast(model), "g").groupBy("s").agg((F.sum("d") / F.count("*")).alias("score")),
        "url_scores",
    )
    bar = _threshold(texts.where("held and action is not null").join(scores, "s"))
    verdict = F.when(F.col("score") >= bar, "allow").otherwise("block")
    judged = known.withColumn("s", model_text(u)).join(scores, "s")
    return judged.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"))


def _threshold(ruled: DataFrame) -> float:
    """The hundredth, from -5 to 5, with the best balanced accuracy; of equals the one nearest 0, then the lower."""
    step = F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("score") * 100))).cast("int")
    bins = ruled.groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col("action") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("action") == "block", F.col("n")).otherwise(0)).alias("b"),
    ).collect()  # at most 1,001 rows
    allowed, blocked = sum(r.a for r in bins), sum(r.b for r in bins)
    if not allowed or not blocked:
        return 0.0

    def good(t: int) -> int:
        return sum(r.a for r in bins if r.step >= t) * blocked + sum(r.b for r in bins if r.step < t) * allowed

    return max(range(-500, 501), key=lambda t: (good(t), -abs(t), -t)) / 100
