"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word stems whose document frequency differs between toxic and other labelled
texts. For training, each third of the sample gets its lexicon features from the other two thirds, so that trees
don't learn from entries that the same text put into the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepath.llm.tables import free_name, stored, text_or_empty

# Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves du dich dir dein deine deinen euch euer ihr tu te toi ton vous votre vos "
    "tú ti tuyo usted ustedes vosotros vuestro".split()
)
# Characters written in place of letters.
_LEET = str.maketrans("013457@$!", "oieastasi")

_STEMS = (4, 5, 6, 7)  # stem lengths beside whole words
_NEAR = 5  # words between a lexicon word and a second-person word that count as near
_FOLDS = 3
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*]+[^\W\d_]+")
_MASKS = frozenset("0123456789@$!*")
_SHOUT = re.compile(r"[!?]{2,}")

Lexicon = dict[str, float]


@dataclass(frozen=True)
class ToxicityParams:
    max_labelled: int = 12_000  # labelled rows to learn from, about; all if there are fewer
    max_lexicon: int = 2_000  # entries of a lexicon, the most telling ones
    min_support: int = 4  # toxic texts that must hold an entry
    trees: int = 20
    depth: int = 4
    seed: int = 7


def _keys(word: str) -> Iterator[str]:
    """A word and its stems; stems end in ``*`` to keep them apart from words."""
    yield word
    for k in _STEMS:
        if len(word) > k:
            yield f"{word[:k]}*"


def _hits(counts: Counter, lexicon: Lexicon, starts: frozenset[str]) -> dict[str, float]:
    """The weight of each word of the text that the lexicon knows, by the heaviest of the word and its stems."""
    found = {}
    for word in counts:
        if word[:4] in starts:
            weight = max((lexicon.get(k, 0.0) for k in _keys(word)), default=0.0)
            if weight:
                found[word] = weight
    return found


def _spelled_out(words: list[str]) -> list[str]:
    """Words written as four or more single letters in a row."""
    runs, run, last = [], "", -2
    for i in [i for i, w in enumerate(words) if len(w) == 1 and w.isalpha()] + [len(words) + 1]:
        if i != last + 1:
            runs.append(run)
            run = ""
        if i < len(words):
            run += words[i]
        last = i
    return [r for r in runs if len(r) > 3]


def _stretched(text: str) -> int:
    """How often a letter is repeated four times or more."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(c) < 4:
        return 0
    same = c[1:] == c[:-1]
    four = same[2:] & same[1:-1] & same[:-2]
    starts = np.flatnonzero(four & ~np.concatenate([[False], four[:-1]]))
    return sum(chr(c[i]).isalpha() for i in starts)


FEATURES = (
    "hit_density", "log_hits", "log_kinds", "weight_density", "heaviest", "second_heaviest", "near_you",
    "you_density", "unmasked_hits", "capitals", "shouted_words", "punctuation", "shouts", "masked_words", "spaced_words",
    "stretched_words",
)


def features_of(text: str, lexicon: Lexicon, starts: frozenset[str]) -> list[float]:
    """The dense features of a whole text, all finite; zeros for an empty one."""
    words = _WORD.findall(text.lower())
    counts = Counter(words)
    n, chars = max(1, len(words)), max(1, len(text))
    found = _hits(counts, lexicon, starts)
    hits = sum(counts[w] for w in found)
    top = sorted(found.values(), reverse=True)[:2] + [0.0, 0.0]
    you = {w: counts[w] for w in SECOND_PERSON & counts.keys()}
    near = 0
    if found and you:
        mine = np.array([i for i, w in enumerate(words) if w in you])
        at = np.array([i for i, w in enumerate(words) if w in found])
        k = np.searchsorted(mine, at)
        gap = np.minimum(np.abs(at - mine[np.minimum(k, len(mine) - 1)]), np.abs(at - mine[np.maximum(k - 1, 0)]))
        near = int((gap <= _NEAR).sum())
    letters = Counter(text)
    capitals = sum(k for c, k in letters.items() if c.isupper())
    marks = sum(k for c, k in letters.items() if not c.isalnum() and not c.isspace())
    masked = _MASKED.findall(text) if letters.keys() & _MASKS else []
    spaced = _spelled_out(words)
    unmasked = Counter([*spaced, *(w.lower().translate(_LEET) for w in masked)])
    loud = capitals > 0.3 * chars
    return [
        hits / n,
        math.log1p(hits),
        math.log1p(len(found)),
        sum(counts[w] * v for w, v in found.items()) / n,
        top[0],
        top[1],
        near / n,
        sum(you.values()) / n,
        math.log1p(len(_hits(unmasked, lexicon, starts))),
        capitals / chars,
        sum(len(w) > 2 and w.isupper() for w in _WORD.findall(text)) / n if loud else 0.0,
        marks / chars,
        len(_SHOUT.findall(text)) / n if letters["!"] + letters["?"] > 1 else 0.0,
        len(masked) / n,
        len(spaced) / n,
        _stretched(text) / n,
    ]


def _lexicons(sample: DataFrame, params: ToxicityParams) -> list[Lexicon]:
    """A lexicon for each fold, from the rows of the other folds, and last the one of all rows.

    Document frequencies are summed within each batch of a task, then by Spark; an entry comes to the driver
    only if it is among the ``max_lexicon`` most telling ones.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic, fold in zip(batch.text, batch.toxic, batch.fold):
                keys = {k for w in set(_WORD.findall(text.lower())) for k in _keys(w)}
                seen.update((k, fold, toxic) for k in keys)
            if seen:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["key", "fold", "toxic", "n"])

    totals = {(r.fold, r.toxic): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    column = lambda fold, toxic: F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == toxic), F.col("n")).otherwise(0))
    counted = stored(
        sample.mapInPandas(count, "key string, fold int, toxic int, n long")
        .groupBy("key")
        .agg(*(column(f, t).alias(f"n{f}{t}") for f in range(_FOLDS) for t in (0, 1)))
        .where(" + ".join(f"n{f}1" for f in range(_FOLDS)) + f" >= {params.min_support}"),
        "lexicon",
    )
    lexicons = []
    for out in range(_FOLDS + 1):
        use = [f for f in range(_FOLDS) if f != out]
        n1, n0 = (sum(totals.get((f, t), 0) for f in use) for t in (1, 0))
        k1, k0 = (sum((F.col(f"n{f}{t}") for f in use), F.lit(0)) for t in (1, 0))
        rate1, rate0 = (k1 + 0.5) / (n1 + 1.0), (k0 + 0.5) / (n0 + 1.0)
        weight = F.log(rate1 / rate0)
        sure = weight / F.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))  # in standard errors
        best = (
            counted.where(k1 >= params.min_support)
            .select("key", weight.alias("weight"), sure.alias("sure"))
            .where("weight > 1 and sure > 3.5")
            .orderBy(F.desc("sure"), "key")
            .limit(params.max_lexicon)
        )
        lexicons.append({r.key: r.weight for r in best.collect()})
    return lexicons


def with_features(df: DataFrame, lexicons: list[Lexicon], text: str, fold: str | None = None, out: str = "features") -> DataFrame:
    """Add the feature array; ``fold`` names the column that picks a row's lexicon, by default the last one."""

    starts = [frozenset(k[:4] for k in lexicon) for lexicon in lexicons]

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([features_of(t, lexicons[k], starts[k]) for t, k in zip(texts, folds)])

    return df.withColumn(out, features(text_or_empty(text), F.lit(len(lexicons) - 1) if fold is None else F.col(fold)))


def training_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """``(text, toxic, fold)`` of about ``max_labelled`` labelled documents, chosen by a hash of the id.

    A document labelled several times is toxic if any label says so; null ids and null labels are left out.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = one.count()
    share = min(1.0, params.max_labelled / max(1, n))
    chosen = one.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        "doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(_FOLDS)).cast("int").alias("fold")
    )
    few = F.broadcast(chosen) if params.max_labelled <= 1_000_000 else chosen  # 16 bytes a row
    return stored(docs.select("doc_id", text_or_empty("text").alias("text")).join(few, "doc_id").select("text", "toxic", "fold"), "labelled")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), score: str = "score"
) -> DataFrame:
    """``docs`` with the column ``score``: the calibrated chance, 0 to 1, that a text is toxic.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1) of the documents to learn from, and only these are learned from. Null and empty
    texts get a score like any other. Without labels of both kinds, every score is the smoothed share of toxic
    labels. Every row stays, with all its columns.
    """
    sample = training_sample(docs, labels, params)
    kinds = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        prior = (kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2)
        return docs.withColumn(score, F.lit(prior))
    lexicons = _lexicons(sample, params)
    known = stored(
        with_features(sample, lexicons, "text", "fold").select("features", F.col("toxic").cast("double").alias("label"), "fold"),
        "toxicity_features",
    )
    # The bounded sample is small: two tasks a step keep the many steps of the fit short.
    known = known.withColumn("features", array_to_vector("features")).coalesce(2).cache()
    trees = GBTClassifier(
        maxIter=params.trees, maxDepth=params.depth, stepSize=0.25, minInstancesPerNode=5, subsamplingRate=0.8, seed=params.seed
    )
    margin = lambda model, df, raw: model.transform(df).withColumn(free, vector_to_array(raw)[1])
    free = free_name(docs, "margin")
    # Calibrated on each fold by trees that haven't seen it; the trees in use are then grown on all rows.
    unseen = []
    for fold in range(_FOLDS):
        rest, own = known.where(F.col("fold") != fold), known.where(F.col("fold") == fold)
        fit_on = rest if rest.select("label").distinct().count() == 2 else known
        unseen.append(margin(trees.fit(fit_on), own, "rawPrediction").select(free, "label"))
    smooth = IsotonicRegression(labelCol="label", featuresCol=free).fit(reduce(DataFrame.unionByName, unseen))
    final = trees.fit(known)
    known.unpersist()
    names = [free_name(docs, c) for c in ("features", "raw_prediction", "probability", "prediction", "calibrated")]
    smooth = smooth.setPredictionCol(names[4])
    model = final.setFeaturesCol(names[0]).setRawPredictionCol(names[1]).setProbabilityCol(names[2]).setPredictionCol(names[3])
    ready = with_features(docs, lexicons, "text", out=names[0]).withColumn(names[0], array_to_vector(names[0]))
    scored = smooth.transform(margin(model, ready, names[1]))
    # Rows on one step of the isotonic fit still rank by their margin.
    blend = 0.98 * F.col(names[4]) + 0.02 / (1 + F.exp(-2 * F.col(free)))
    return scored.withColumn(score, blend).drop(*names, free)
