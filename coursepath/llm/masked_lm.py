"""Masked pseudo-likelihood scores by a bidirectional window network trained in numpy.

Each word is predicted from the two words before it and the two after it; a document's score is the sum of the
log-probabilities of all its words. The network gives the probability of the word's class, in two steps: a group of classes, then
a class of the group. Half of the classes are words of their own, the most frequent ones; the other half is shared by all other words, by
their endings, and there a word has its share of its class by the counts of the whole corpus. The number of classes grows with the
square root of the number of different words.

Words are counted and turned into class numbers once, and stored. Training goes over every position of every document: shards of
documents, dealt out by a digest, start a round from the same weights and run through their positions in a fixed order, and
Spark averages the shards' weights by tokens. So neither the files nor the tasks decide the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import ceil, isqrt, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from coursepath.llm.tables import frequent, stored, text_or_empty

_REACH = 2  # words seen on each side
_WORD = re.compile(r"[^\W_]+")
_BLANKED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))  # blanks for the ASCII characters of no word
_SCORED = 1 << 14  # positions scored at once
_ENCODED = 256  # texts numbered at once
_COUNTED = 1 << 18  # different words that a task counts before it passes them on


@dataclass(frozen=True)
class MaskedLmParams:
    side: int | None = None  # groups, and classes of a group; by default they grow with the words of the corpus
    width: int = 16
    rounds: int = 2  # each trains on one position in so many, so that all rounds together train on every position once
    hot: int = 1 << 19  # words whose class and share each task holds; those of the others are joined
    tokens_per_shard: int = 4_000_000
    batch: int = 8_192
    rate: float = 0.1
    seed: int = 5


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).decode("utf-8", "surrogatepass").split()
    # Only a text with other marks than those of ASCII and blanks needs the pattern, which takes twice the time.
    return words if "".join(words).isalnum() else _WORD.findall(" ".join(words))


def _ending(word: str, shared: int) -> int:
    return zlib.crc32(word[-3:].encode()) % shared


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers, added up in the task as far as memory is bounded."""
    seen: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(words_of(text.as_py()))
            if len(seen) >= _COUNTED:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


@dataclass(frozen=True)
class Vocabulary:
    """Classes: ``own`` words have one each, then come the shared ones. ``number`` places the held words in the arrays."""

    side: int
    own: int
    number: dict[str, int]
    classes: np.ndarray  # of the held words
    log_shares: np.ndarray  # of the held words within their classes
    totals: np.ndarray  # words of the corpus by class

    @property
    def size(self) -> int:
        return self.side**2

    @property
    def shared(self) -> int:
        return self.size - self.own

    @property
    def kind(self) -> type[np.generic]:
        """The type in which class numbers are stored: two bytes are enough for the words of nearly any corpus."""
        return np.uint16 if self.size < 1 << 16 else np.int32

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Class numbers of all words; per text the sum of the held words' log-shares, and the words that aren't held."""
        sizes, flat = [len(words) for words in texts], list(chain.from_iterable(texts))
        at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), sizes)
        held = at >= 0
        classes = np.empty(len(at), np.int32)
        classes[held] = self.classes[at[held]]
        shares = np.bincount(owner[held], self.log_shares[at[held]], len(texts))
        others: list[list[str]] = [[] for _ in texts]
        endings: dict[str, int] = {}
        for k, text in zip(*(x[~held].tolist() for x in (np.arange(len(flat)), owner))):
            w = flat[k]
            others[text].append(w)
            if (end := w[-3:]) not in endings:
                endings[end] = self.own + _ending(w, self.shared)
            classes[k] = endings[end]
        return classes, shares, others


def _class_of(own: DataFrame, n_own: int, shared: int, words: DataFrame) -> DataFrame:
    """Adds ``class`` to a table of words ``w``."""
    ending = n_own + F.crc32(F.expr("right(w, 3)")) % shared
    return words.join(F.broadcast(own), "w", "left").withColumn("class", F.coalesce("own", ending).cast("int")).drop("own")


class Network:
    """Weights: an embedding per place and class, a hidden layer, and the two steps of the output."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.around, self.bias, self.out1, self.even1, self.out2, self.even2 = parts

    @classmethod
    def blank(cls, vocabulary: Vocabulary, params: MaskedLmParams) -> Network:
        """Weights that predict every class by its share of the corpus."""
        side, width = vocabulary.side, params.width
        share = vocabulary.totals.reshape(side, side) + 1.0
        group = share.sum(1)
        around = np.random.default_rng(params.seed).normal(0, 0.3, (2 * _REACH, side * side + 1, width))
        parts = [around, np.zeros(width), np.zeros((width, side)), np.log(group / group.sum()), np.zeros((side, width, side)), np.log(share / group[:, None])]
        return cls([p.astype(np.float32) for p in parts])

    @property
    def side(self) -> int:
        return len(self.even1)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def shaped(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([p.size for p in self.parts])[:-1]
        return Network([x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cuts), self.parts)])

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        context = [ids.take(at + k) for k in range(-_REACH, _REACH + 1) if k]
        total = _rows(self.bias + self.around[0], context[0])
        for k in range(1, len(context)):
            total += _rows(self.around[k], context[k])
        return context, np.tanh(total, out=total)

    def second(self, hidden: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """The second step with the rows in the order of their groups: that order, the hidden rows in it, each group's bounds,
        the logits, and the class within the group."""
        first, place = np.divmod(target, self.side)
        # Numbers of 16 bits are sorted by their digits.
        order = np.argsort(first.astype(np.int16) if self.side < 1 << 15 else first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(self.side + 1)).tolist()
        bounds = [(g, x, y) for g, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
        sorted_, logits = _rows(hidden, order), np.empty((len(target), self.side), np.float32)
        for g, x, y in bounds:
            np.matmul(sorted_[x:y], self.out2[g], out=logits[x:y])
            logits[x:y] += self.even2[g]
        return order, sorted_, bounds, logits, place[order]

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, hidden = self.hidden(ids, at)
        target = ids[at]
        out = _log_share(_sum(hidden @ self.out1, self.even1), target // self.side)
        order, _, _, logits, place = self.second(hidden, target)
        out[order] += _log_share(logits, place)
        return out

    def train(self, ids: np.ndarray, at: np.ndarray, params: MaskedLmParams) -> None:
        """Adagrad steps over the positions ``at``, in place."""
        squares = [np.full_like(p, 1e-4) for p in self.parts]
        padded = self.side**2 + 1
        for start in range(0, len(at), params.batch):
            here = at[start : start + params.batch]
            target, n = ids[here], len(here)
            starts, back_at = np.arange(n) * self.side, np.empty(n, np.int64)
            context, hidden = self.hidden(ids, here)
            wrong = _softmax(_sum(hidden @ self.out1, self.even1))
            wrong.reshape(-1)[starts + target // self.side] -= 1
            back = wrong @ self.out1.T
            order, sorted_, bounds, off, place = self.second(hidden, target)
            off = _softmax(off)
            off.reshape(-1)[starts + place] -= 1
            steps = [None, None, hidden.T @ wrong, wrong.sum(0), np.zeros_like(self.out2), np.zeros_like(self.even2)]
            passed = np.empty_like(sorted_)
            for g, x, y in bounds:
                np.matmul(off[x:y], self.out2[g].T, out=passed[x:y])
                np.matmul(sorted_[x:y].T, off[x:y], out=steps[4][g])
                steps[5][g] = off[x:y].sum(0)
            back_at[order] = np.arange(n)
            back += _rows(passed, back_at)
            back *= 1 - hidden**2
            steps[1] = back.sum(0)
            # The sum over the positions that have used an embedding, component by component.
            steps[0], components = np.empty_like(self.around), np.ascontiguousarray(back.T, np.float64)
            for k, c in enumerate(context):
                places = c.astype(np.int64)
                for j, component in enumerate(components):
                    steps[0][k, :, j] = np.bincount(places, component, padded)
            for part, step, square in zip(self.parts, steps, squares):
                step /= np.float32(n)
                scale = step * step
                square += scale
                np.sqrt(square, out=scale)
                scale += np.float32(1e-6)
                step *= np.float32(params.rate)
                step /= scale
                part -= step


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` of a table with rows in one piece, each of which is moved as a whole."""
    whole = np.dtype((np.void, table.shape[1] * table.itemsize))
    return table.view(whole).reshape(-1).take(at).view(table.dtype).reshape(len(at), table.shape[1])


def _sum(logits: np.ndarray, even: np.ndarray) -> np.ndarray:
    logits += even
    return logits


def _shifted(logits: np.ndarray) -> np.ndarray:
    """Logits less a number for each row, so that no exponential overflows and no row's all underflow; in place."""
    high = logits.max(initial=-np.inf)
    logits -= high if high - logits.min(initial=np.inf) < 60 else logits.max(1, keepdims=True)
    return logits


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.exp(_shifted(logits), out=logits)
    logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits


def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    picked = _shifted(logits)[np.arange(len(logits)), chosen].astype(np.float64)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _stream(lists: pa.BinaryArray, pad: int, kind: type[np.generic]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lists, each the bytes of its numbers, one after another with pads around each; the places of the tokens, and how many
    each list has."""
    _, bounds, data = lists.buffers()
    ends = np.frombuffer(bounds, np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
    values = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    sizes = np.diff(ends) // np.dtype(kind).itemsize
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) + _REACH * (owner + 1)
    ids = np.full(len(values) + _REACH * (len(sizes) + 1), pad, np.int32)
    ids[at] = values
    return ids, at, sizes


@dataclass(frozen=True)
class MaskedLm:
    vocabulary: Vocabulary
    sent: Broadcast | None  # the vocabulary, for the tasks
    network: Network
    counts: DataFrame  # all words of the corpus: w and n


def _held_words(counts: DataFrame, params: MaskedLmParams) -> tuple[int, list[tuple[str, int]]]:
    """The side of the classes for a table of words, and its most frequent words."""
    side = params.side or max(4, ceil(sqrt(isqrt(counts.count()))))
    held = counts.where(frequent(counts, "n", params.hot)).toPandas()
    return side, sorted(zip(held.w, held.n), key=lambda x: (-x[1], x[0]))


def _encoded(docs: DataFrame, sent: Broadcast, id: str, text: str) -> DataFrame:
    """``(id, row, digest, packed, log_share, others)`` for every row, stored: the class numbers are the bytes of ``packed``."""
    schema = StructType(
        [
            StructField("id", docs.schema[id].dataType),
            StructField("row", LongType()),
            StructField("ids", ArrayType(IntegerType())),  # for the digest
            StructField("packed", BinaryType()),
            StructField("log_share", DoubleType()),
            StructField("others", ArrayType(StringType())),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = sent.value.kind
        for batch in batches:
            for x in range(0, len(batch), _ENCODED):
                part = batch.slice(x, _ENCODED)
                words = [words_of(t.as_py()) for t in part.column(2)]
                ids, shares, others = sent.value.encode(words)
                ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                data = ids.astype(kind)
                packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends * np.int32(data.itemsize)), pa.py_buffer(data)])
                columns = [part.column(0), part.column(1), lists, packed, pa.array(shares, pa.float64()), pa.array(others, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    read = docs.select(F.col(f"`{id}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text).alias("text"))
    digest = F.xxhash64("id", "ids").alias("digest")
    return stored(read.mapInArrow(encode, schema).select("id", "row", digest, "packed", "log_share", "others"), "encoded")


def _round(shards: DataFrame, network: Network, vocabulary: Vocabulary, number: int, params: MaskedLmParams) -> Network:
    pad, kind = vocabulary.size, vocabulary.kind

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trained(waiting: list) -> pa.RecordBatch:
            ids, at, _ = _stream(pa.concat_arrays(waiting), pad, kind)
            at = at[(np.arange(len(at)) + number) % params.rounds == 0]
            mine = Network([p.copy() for p in network.parts])
            mine.train(ids, at, params)
            flat = mine.flat()
            weights = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.float32()))
            return pa.RecordBatch.from_arrays([weights, pa.array([len(at)], pa.int64())], ["w", "n"])

        shard, waiting = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x and numbers[x] != shard:
                    if waiting:
                        yield trained(waiting)
                    shard, waiting = numbers[x], []
                waiting.append(batch.column(1).slice(x, y - x))
        if waiting:
            yield trained(waiting)

    each = shards.mapInArrow(train, "w array<float>, n long").where("n > 0")
    mean = each.select(F.posexplode("w").alias("k", "x"), "n").groupBy("k").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    rows = mean.toPandas()  # as many rows as the network has weights
    return network.shaped(rows.sort_values("k").x.to_numpy()) if len(rows) else network


def train_masked_lm(docs: DataFrame, params: MaskedLmParams = MaskedLmParams(), id: str = "doc_id", text: str = "text") -> tuple[MaskedLm, DataFrame]:
    """The network of a corpus, and the corpus in class numbers, for ``score_encoded``.

    Null and empty texts teach nothing; an empty corpus gives an even prediction. The driver holds the network, the ``hot`` words and
    a number for each class.
    """
    spark = docs.sparkSession
    words = docs.select(text_or_empty(text).alias("text")).mapInArrow(_counted, "w string, n long")
    counts = stored(words.groupBy("w").agg(F.sum("n").alias("n")), "word_counts")
    side, held = _held_words(counts, params)
    n_own = min(side * side // 2, len(held))
    table = pd.DataFrame({"w": [w for w, _ in held[:n_own]], "own": range(n_own)}).astype({"w": object, "own": "int32"})
    own = spark.createDataFrame(table, "w string, own int")
    totals = np.zeros(side * side, np.int64)
    for r in _class_of(own, n_own, side * side - n_own, counts).groupBy("class").agg(F.sum("n").alias("n")).collect():  # one row a class
        totals[r["class"]] = r.n
    classes = np.array([k if k < n_own else n_own + _ending(w, side * side - n_own) for k, (w, _) in enumerate(held)], np.int64)
    n = np.array([n for _, n in held], np.float64)
    shares = np.where(np.arange(len(held)) < n_own, 0.0, np.log(n / (totals[classes] + 1.0)) if len(held) else 0.0)
    vocabulary = Vocabulary(side, n_own, {w: k for k, (w, _) in enumerate(held)}, classes, shares, totals)
    sent = spark.sparkContext.broadcast(vocabulary)
    encoded = _encoded(docs, sent, id, text)

    network = Network.blank(vocabulary, params)
    if params.rounds:
        n_shards = max(1, int(totals.sum()) // params.tokens_per_shard)
        marked = encoded.select(F.pmod("digest", F.lit(n_shards)).cast("int").alias("shard"), "packed", "digest", "id")
        shards = marked.repartition(n_shards, "shard").sortWithinPartitions("shard", "digest", "id").select("shard", "packed")
        for number in range(params.rounds):
            network = _round(shards, network, vocabulary, number, params)
    return MaskedLm(vocabulary, sent, network, counts), encoded


def score_encoded(encoded: DataFrame, model: MaskedLm, id: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, log_likelihood, per_token)`` for every row of a table of class numbers. See ``score_documents``."""
    network, pad, kind = model.network, model.vocabulary.size, model.vocabulary.kind

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, sizes = _stream(batch.column(3), pad, kind)
            logs = np.concatenate([np.empty(0), *(network.log_probabilities(ids, at[x : x + _SCORED]) for x in range(0, len(at), _SCORED))])
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes)) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums)], ["id", "row", "n_tokens", "logs"])

    schema = StructType([encoded.schema["id"], encoded.schema["row"], StructField("n_tokens", LongType()), StructField("logs", DoubleType())])
    scored = encoded.select("id", "row", "log_share", "packed").mapInArrow(score, schema)
    # One row for each class.
    totals = pd.DataFrame({"class": np.arange(pad, dtype=np.int32), "total": model.vocabulary.totals + 1.0})
    ending = model.vocabulary.own + F.crc32(F.expr("right(w, 3)")) % model.vocabulary.shared
    # Words with a class of their own are all held. Words that occur once need no look-up: a word that isn't found counts as one.
    repeated = model.counts.where("n > 1")
    others = encoded.where("size(others) > 0").select("row", F.explode("others").alias("w")).join(repeated, "w", "left")
    others = others.withColumn("class", ending.cast("int")).join(F.broadcast(encoded.sparkSession.createDataFrame(totals)), "class")
    shares = others.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)) / F.col("total"))).alias("shares"))
    n, sums = F.col("n_tokens"), F.col("logs") + F.coalesce("shares", F.lit(0.0))
    return scored.join(shares, "row", "left").select(F.col("id").alias(id), n, sums.alias("log_likelihood"), F.when(n > 0, sums / n).alias("per_token"))


def score_documents(docs: DataFrame, model: MaskedLm, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, log_likelihood, per_token)`` for every row.

    Null, empty and wordless texts have no tokens, a sum of 0 and no mean. Whole texts count, however long; repeated rows and null
    ids are rows like any other. A class keeps room for one more word than the corpus has in it, which words that the corpus lacks get.
    """
    return score_encoded(_encoded(docs, model.sent, id, text), model, id)
