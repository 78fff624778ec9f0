"""Periodic runs of words: stretches that repeat a period at least four times, found by an online sparse diagonal DP.

Each word's earlier occurrences extend the match lengths of their lags (diagonals), and a diagonal that ends with
enough matches is a run. Words that can be in no run never reach the DP: each three-word shingle of a run comes three times in it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from coursepath.llm.tables import text_or_empty

MIN_WORDS = 6
MIN_EXPONENT = 4
_SHINGLE = 3  # a run of an exponent e and of e + 1 words or more holds each of its three-word shingles e - 1 times
_BATCH_CHARS = 1 << 20  # characters searched at once, or one text if it is longer

Run = tuple[int, int, int]  # start, length, period


def _breaks(at: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where a new part begins: at a gap between positions, or where the old part changes."""
    return np.concatenate([[True], (np.diff(at) != 1) | (np.diff(part) != 0)])


def candidate_stretches(ids: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (first position, end) of words that hold all runs: their shingles recur within the stretch.

    Counting by hashes can only keep too much. Stretches shrink until nothing goes any more.
    """
    n = len(ids) - _SHINGLE + 1
    if n <= 0:
        return []
    at = np.flatnonzero(text_of[:n] == text_of[_SHINGLE - 1 :])
    mix = np.uint64(0x9E3779B97F4A7C15)
    x = ids.astype(np.uint64)
    shingle = ((x[:n] * mix) ^ x[1 : n + 1]) * mix ^ x[2 : n + 2]
    part = text_of[at].astype(np.int64)
    while len(at):
        key = (shingle[at] * mix ^ part.astype(np.uint64)) * mix
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        keep = times[inverse] >= MIN_EXPONENT - 1
        old = len(at)
        at, part = at[keep], part[keep]
        if not len(at):
            break
        first = _breaks(at, part)
        part = np.cumsum(first) - 1
        long = np.bincount(part)[part] >= MIN_WORDS - _SHINGLE + 1
        at, part = at[long], part[long]
        if len(at) == old:
            break
    if not len(at):
        return []
    first = np.flatnonzero(_breaks(at, part))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return [(s, e + _SHINGLE) for s, e in zip(at[first].tolist(), at[last].tolist())]


def diagonal_runs(words: list[int]) -> list[Run]:
    """All runs of a list of words, by start and period.

    ``active`` holds the match length of each lag that matched the word before. Between two places inside a stretch of three periods q
    and more, no lag above q begins a run of its own: multiples of q end where q ends, and others match fewer than q
    words. They are left out there, and their match lengths are counted back when the stretch ends.
    """
    n, at = len(words), {}
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    cover = 0  # the period of the stretch that leaves out lags: the least lag with two periods of matches when it began; 0 if none

    def ended(lag: int, matches: int, end: int) -> None:
        if matches + lag >= max(MIN_WORDS, MIN_EXPONENT * lag):
            place = (end - matches - lag, matches + lag)
            found[place] = min(found.get(place, lag), lag)

    def begin(now: dict[int, int], places, i: int, back: bool) -> None:
        for j in places:
            lag = i - j
            if lag in now:
                continue
            matches = 1
            while back and matches <= j and words[i - matches] == words[j - matches]:
                matches += 1
            if matches + n - 1 - i >= (MIN_EXPONENT - 1) * lag:
                now[lag] = matches

    for i, word in enumerate(words):
        places = at.setdefault(word, [])
        now = {lag: k + 1 for lag, k in active.items() if words[i - lag] == word}
        if len(now) < len(active):
            for lag, k in active.items():
                if lag not in now:
                    ended(lag, k, i)
        low = bisect_left(places, i - n // MIN_EXPONENT)  # a longer lag has no room for its repeats
        if cover in now:
            near, far = bisect_left(places, i - cover), bisect_left(places, i + 1 - now[cover] - cover)
            begin(now, places[max(near, low) :], i, False)
            begin(now, places[low:far], i, False)
        else:
            begin(now, places[low:], i, cover > 0)
        active = now
        if cover not in active:
            cover = min((lag for lag, k in active.items() if k >= 2 * lag), default=0)
        places.append(i)
    for lag, k in active.items():
        ended(lag, k, n)
    return sorted((s, length, lag) for (s, length), lag in found.items())


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    for first, end in candidate_stretches(ids, text_of):
        k = int(text_of[first])
        shift = first - int(starts[k])
        out[k] += [(s + shift, length, period) for s, length, period in diagonal_runs(ids[first:end].tolist())]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> str:
    """The words joined by spaces, of each run only the first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words).decode()


def _searched(rewrite: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            x = 0
            while x < len(texts):
                chunk, chars, y = [], 0, x
                while y < len(texts) and (y == x or chars < _BATCH_CHARS):
                    text = texts[y].as_py()
                    chars += len(text)
                    words = text.encode().split()  # of bytes: at the ASCII white space alone
                    chunk.append(words if rewrite is None else rewrite(ids[y].as_py(), words))
                    y += 1
                runs = runs_of_texts(chunk)
                found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], kind)
                rest = pa.array([collapsed(w, r) for w, r in zip(chunk, runs)], pa.string())
                names = ["id", "n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), pa.array([len(w) for w in chunk], pa.int64()), found, rest], names)
                x = y

    return run


def periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` for every row.

    Words are what stands between ASCII white space. A run is a stretch of words with least period q (words q apart are the same) and at least
    ``max(6, 4 q)`` words, which no word before or behind it continues. ``runs`` lists ``(start, length, period)`` by start
    and period, ``start`` being the number of a word; ``collapsed`` is the text without the words of a run behind its first period, joined
    by one space. ``rewrite`` may change the words of a row first; it gets the id and the words.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so ids may be null
    or repeated; texts may have any length. No rows give no rows.
    """
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType(
        [
            StructField("id", docs.schema[id].dataType),
            StructField("n_words", LongType()),
            StructField("runs", ArrayType(run)),
            StructField("collapsed", StringType()),
        ]
    )
    read = docs.select(F.col(f"`{id}`").alias("id"), text_or_empty(text).alias("text"))
    return read.mapInArrow(_searched(rewrite), schema).withColumnRenamed("id", id)
