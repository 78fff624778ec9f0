"""Alignment of two tokenizers over a corpus, by the bytes that their tokens cover.

A group is a stretch of text between two neighbouring places at which tokens of both tokenizers end. A group of one
token on each side whose ids the identity map joins takes the fast path: it is counted in a vector as long as the
vocabulary. Only the links of all other groups are counted as id pairs, in a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from coursepath.llm.tables import frequent, joined_by_frequency, stored, text_or_empty

# Fixed values of byte-level BPE: the split pattern, and the bytes that stand for themselves in entries.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_BATCH_CHARS = 1 << 19  # characters aligned at once, or one text if it is longer
_HOT_PAIRS = 1 << 18  # id pairs whose counts are broadcast; all others meet theirs in a shuffle
_DOC, _PAIRS, _IDENTICAL = 0, 1, 2


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an id without an entry has none."""
    others = [b for b in range(256) if b not in set(PRINTED)]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def piece_tokens(model: bytes) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each id of A the id of B with the same bytes, -1 if there is none; of several the greatest, a whole piece."""
    at = {token: i for i, token in enumerate(b) if token}
    return np.array([at.get(token, -1) for token in a], np.int64)


@dataclass(frozen=True)
class Tokenizers:
    """``a`` is the JSON of a byte-level BPE tokenizer, ``b`` a sentencepiece model, which adds a space before the text."""

    a: str
    b: bytes
    tokens_a: list[bytes] = field(init=False, repr=False)
    tokens_b: list[bytes] = field(init=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "tokens_a", byte_level_tokens(json.loads(self.a)["model"]["vocab"] | self._added()))
        object.__setattr__(self, "tokens_b", piece_tokens(self.b))

    def _added(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in json.loads(self.a).get("added_tokens", [])}

    def pair(self, a, b):
        return a * len(self.tokens_b) + b

    def encoder_a(self) -> Callable[[list[str]], list[np.ndarray]]:
        """Encodes with special strings as plain text.

        Where the ids are in the order of the merges, as is usual, ``tiktoken`` gives the same ids in a fifth of the time.
        """
        spec = json.loads(self.a)
        vocabulary, added = spec["model"]["vocab"], self._added()
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        made = [vocabulary[m.replace(" ", "")] for m in merges]
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
        if plain and made == sorted(made) and len(vocabulary) - len(added.keys() & vocabulary.keys()) == 256 + len(merges):
            import tiktoken

            ranks = {self.tokens_a[i]: i for entry, i in vocabulary.items() if entry not in added}
            bpe = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [np.array(bpe.encode_ordinary(t), np.int64) for t in texts]
        from tokenizers import Tokenizer

        lib = Tokenizer.from_str(self.a)
        lib.encode_special_tokens = True
        lib.no_truncation()
        lib.no_padding()
        return lambda texts: [np.array(e.ids, np.int64) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encoder_b(self) -> Callable[[list[str]], list[np.ndarray]]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.b)
        return lambda texts: [np.array(ids, np.int64) for ids in sp.encode(texts, num_threads=1)]


def _counts(owner: np.ndarray, key: np.ndarray, n_keys: int, n_owners: int, weight=None):
    """Per owner the distinct keys and how often each occurs: list offsets, keys, numbers."""
    both, inverse = np.unique(owner * n_keys + key, return_inverse=True)
    n = np.bincount(inverse, weights=weight, minlength=len(both)).astype(np.int64)
    return np.searchsorted(both, np.arange(n_owners + 1) * n_keys), both % n_keys, n


class _Aligner:
    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.encode_a, self.encode_b = tokenizers.encoder_a(), tokenizers.encoder_b()
        self.bytes_a, self.bytes_b = tokenizers.tokens_a, tokenizers.tokens_b
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.same = identity_map(self.bytes_a, self.bytes_b)
        self.n_pairs = len(self.bytes_a) * len(self.bytes_b)
        self.identical = np.zeros(len(self.bytes_a), np.int64)  # one-to-one groups by id of A
        most = max(len(self.bytes_a), len(self.bytes_b))
        text = np.arange(most).astype(f"S{len(str(most))}")
        self.digits = np.frombuffer(text.tobytes(), np.uint8).reshape(most, text.itemsize)

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        none = np.empty(0, np.int64)
        a, b = self.encode_a([" " + t for t in texts]), self.encode_b(texts)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            fits = b"".join([self.bytes_a[i] for i in a[k].tolist()]) == whole == b"".join([self.bytes_b[i] for i in b[k].tolist()])
            if not t or not fits:
                a[k] = b[k] = none
        return a, b

    def _written(self, a, b, group_a, group_b, last_a, last_b, first_a, first_b, n_a, sizes) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2``."""
        place_a = np.arange(len(a)) + first_b[group_a]
        place_b = np.arange(len(b)) + first_a[group_b] + n_a[group_b]
        wide = self.digits.shape[1]
        out = np.zeros((len(a) + len(b), wide + 1), np.uint8)
        out[place_a, :wide], out[place_b, :wide] = self.digits[a], self.digits[b]
        out[place_a, wide] = np.where(last_a, ord("|"), ord(","))
        out[place_b, wide] = np.where(last_b, ord(";"), ord(","))
        ends = np.concatenate([[0], np.cumsum(np.count_nonzero(out, axis=1))])[np.concatenate([[0], np.cumsum(sizes)])]
        flat = out.ravel()
        text = flat[flat != 0].tobytes().decode("ascii")
        return [text[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def align(self, texts: list[str]):
        """Per text: tokens of A, of B, groups, their text, and the id pairs of its links with their numbers; and the irregular pairs of all."""
        ids_a, ids_b = self._ids(texts)
        size_a, size_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.zeros((end_a[-1] if len(a) else 0) + 1, np.uint8)
        ends[end_a] += 1
        ends[end_b] += 2
        last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        text_of = np.repeat(np.arange(len(texts)), size_a)[first_a]
        fast = (n_a == 1) & (n_b == 1)
        fast[fast] = self.same[a[first_a[fast]]] == b[first_b[fast]]

        # A link covers the bytes between two neighbouring ends, of whichever side.
        link = np.flatnonzero(ends)
        of_a, of_b = ends[link] & 1, ends[link] >> 1
        link_a, link_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        group = group_a[link_a]
        pair = self.t.pair(a[link_a], b[link_b])
        offsets, keys, n = _counts(text_of[group], pair, self.n_pairs, len(texts))

        self.identical += np.bincount(a[first_a[fast]], minlength=len(self.identical))
        odd, n_odd = np.unique(pair[~fast[group]], return_counts=True)
        written = self._written(a, b, group_a, group_b, last_a, last_b, first_a, first_b, n_a, size_a + size_b)
        groups = np.bincount(text_of, minlength=len(texts))
        return size_a, size_b, groups, written, (offsets, keys, n), (odd, n_odd)

    def identical_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.identical)
        return self.t.pair(at, self.same[at]), self.identical[at]


def _rows(schema: pa.Schema, kind, ids, row, numbers, groups, lists) -> pa.RecordBatch:
    offsets, keys, n = (np.asarray(x) for x in lists)
    as_lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (keys, n)]
    arrays = [pa.array(np.full(len(row), kind), pa.int32()), ids, row, *[pa.array(x, pa.int64()) for x in numbers], pa.array(groups, pa.string()), *as_lists]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= _BATCH_CHARS or k == len(texts) - 1:
            yield start, k + 1
            start, chars = k + 1, 0


def _aligned(tokenizers: Tokenizers, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, schema = _Aligner(tokenizers), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            kinds = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            schema = pa.schema(list(zip(names, kinds)))
            texts = batch.column(2).to_pylist()
            for x, y in _chunks(texts):
                *numbers, groups, lists, (odd, n) = aligner.align(texts[x:y])
                ids, row = batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x)
                yield _rows(schema, _DOC, ids, row, numbers, groups, lists)
                if len(odd):
                    yield _pair_rows(schema, _PAIRS, odd, n)
        if schema is not None and aligner.identical.any():
            yield _pair_rows(schema, _IDENTICAL, *aligner.identical_pairs())

    return run


def _pair_rows(schema: pa.Schema, kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    one = pa.array([0], pa.int64())
    return _rows(schema, kind, pa.nulls(1, schema.field(1).type), one, [one] * 3, [None], ([0, len(keys)], keys, n))


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row for each document; ``pairs``: (a, b, n, best) for each id pair that any link joins."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(
    docs: DataFrame, tokenizers: Tokenizers, id: str = "doc_id", text: str = "text", groups: Callable[[Column], Column] = lambda written: written
) -> Alignment:
    """Align A's tokens of space + text with B's tokens of the text, for every document and the corpus.

    ``documents`` has ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``. A link is an A and a B token occurrence whose
    bytes overlap; the count of an id pair is the number of its links in the corpus; ``n_best`` are the links
    whose count no other A id has more of with the same B id (ties included), and ``count_sum`` adds the counts of all links.
    ``groups`` is written as ``a1,a2|b1;a3|b2``, or whatever the function of that name makes of it before it is stored.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
    ``groups``, and they count for no pair. Rows are judged one by one, so ids may be null or repeated. No rows give no rows.
    """
    names = ["kind", "id", "row", "n_a", "n_b", "n_groups", "groups", "keys", "numbers"]
    kinds = [IntegerType(), docs.schema[id].dataType, *[LongType()] * 4, StringType(), *[ArrayType(LongType())] * 2]
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])
    numbered = docs.select(F.col(f"`{id}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text).alias("text"))
    found = stored(
        numbered.mapInArrow(_aligned(tokenizers, names), schema).withColumn("groups", F.when(F.col("kind") == _DOC, groups(F.col("groups")))),
        "alignment",
    )

    def exploded(kinds: tuple[int, ...], *columns: str) -> DataFrame:
        return found.where(F.col("kind").isin(*kinds)).select(*columns, F.explode(F.arrays_zip("keys", "numbers")).alias("x")).select(
            *columns, F.col("x.keys").alias("pair"), F.col("x.numbers").alias("links")
        )

    n_b = len(tokenizers.tokens_b)
    numbers = exploded((_PAIRS, _IDENTICAL), "kind").groupBy("pair")
    numbers = numbers.agg(F.sum("links").alias("n"), F.max(F.col("kind") == _IDENTICAL).alias("identical"))
    counts = stored(numbers.withColumn("b", F.col("pair") % n_b), "pair_counts")
    # One row for each id of B at most.
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    pairs = stored(
        counts.join(F.broadcast(highest), "b").select("pair", "n", "identical", (F.col("n") == F.col("most")).alias("best")), "pair_values"
    )
    # Identical pairs are no more than the ids of A.
    is_hot = F.col("identical") | frequent(pairs, "n", _HOT_PAIRS)
    links = joined_by_frequency(exploded((_DOC,), "row"), pairs, "pair", is_hot)
    sums = links.groupBy("row").agg(
        F.sum(F.col("links") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best")
    )
    nothing = F.lit(0).cast("long")
    documents = (
        found.where(F.col("kind") == _DOC)
        .join(sums, "row", "left")
        .select(
            F.col("id").alias(id),
            "n_a",
            "n_b",
            "n_groups",
            (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
            F.coalesce("n_best", nothing).alias("n_best"),
            F.coalesce("count_sum", nothing).alias("count_sum"),
            "groups",
        )
    )
    named = pairs.select(F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "n", "best")
    return Alignment(documents, named)
