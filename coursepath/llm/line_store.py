"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables, in a folder of Parquet tables.

A line's key counts the documents that hold it. Inserting documents raises counts, deleting them lowers counts, and a line
comes back where the document that kept its only copy goes. Each change writes a new version: the keys it touched, and the
filters. The filters spare the look-up of keys that are new, and of lines that no other document holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepath.llm.cuckoo import CuckooFilter
from coursepath.llm.tables import frequent, joined_by_frequency, stored, text_or_empty

MIN_CODE_POINTS = 10
NO_ID = 2**63 - 1  # stands for a null id, behind all others

_CHUNK = 1 << 16  # keys counted together before they are shuffled
_HOT_KEYS = 1 << 17  # keys whose owners are broadcast; all others meet theirs in a shuffle
_FILTER_BYTES = 1 << 25  # filters of up to this size are sent to the tasks; beyond it every line is looked up

_LINES = "kind int, doc long, k1 array<long>, k2 array<long>, docs array<int>, owner array<long>"
_REFS = "shard int, k1 long, k2 long, n_docs long, owner long"
_FILTERS = "shard int, held binary, shared binary, n_held long"
_DOC, _COUNTS = 0, 1


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None for a key that is too short: stripped ASCII white space, A-Z in lower case."""
    key = line.strip().lower()  # of bytes: ASCII alone
    if len(key) < MIN_CODE_POINTS or (len(key) < 4 * MIN_CODE_POINTS and not key.isascii() and len(key.decode()) < MIN_CODE_POINTS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _numbers(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _counted(k1, k2, n, owner):
    """Distinct keys with their documents added up and their least owner."""
    order = np.lexsort((owner, k2, k1))
    k1, k2, n, owner = k1[order], k2[order], n[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])[: len(k1)])
    return k1[first], k2[first], np.add.reduceat(n, first) if len(first) else n, owner[first]


def _keys_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with the keys of its lines, and rows of keys counted in the task already."""
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), *[(k, pa.list_(pa.int64())) for k in ("k1", "k2")], ("docs", pa.list_(pa.int32())), ("owner", pa.list_(pa.int64()))])

    def row_lists(offsets, values, kind):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def counts(k1, k2, docs):
        k1, k2, n, owner = _counted(k1, k2, np.ones(len(k1), np.int32), docs)
        one, all_ = pa.array([_COUNTS], pa.int32()), [0, len(k1)]
        lists = [row_lists(all_, k1, pa.int64()), row_lists(all_, k2, pa.int64()), row_lists(all_, n, pa.int32()), row_lists(all_, owner, pa.int64())]
        return pa.RecordBatch.from_arrays([one, pa.nulls(1, pa.int64()), *lists], schema=schema)

    waiting: list[tuple] = []
    for batch in batches:
        found: list[bytes] = []
        ends = [0]
        for text in batch.column(1):
            keys = {line_key(line) for line in text.as_py().encode().split(b"\n")}
            keys.discard(None)
            found += sorted(keys)
            ends.append(len(found))
        k1, k2 = _numbers(found)
        nothing = pa.nulls(len(batch), pa.list_(pa.int32())), pa.nulls(len(batch), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(batch), _DOC), pa.int32()), batch.column(0), row_lists(ends, k1, pa.int64()), row_lists(ends, k2, pa.int64()), *nothing], schema=schema
        )
        waiting.append((k1, k2, np.repeat(batch.column(0).to_numpy(), np.diff(ends))))
        if sum(len(x[0]) for x in waiting) >= _CHUNK:
            yield counts(*map(np.concatenate, zip(*waiting)))
            waiting = []
    if any(len(x[0]) for x in waiting):
        yield counts(*map(np.concatenate, zip(*waiting)))


def _kept_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, k1, k2 in zip(batch.column(1), batch.column(2), batch.column(3)):
            text = text.as_py()
            if not k1.is_valid:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            pairs = np.stack([k1.values.to_numpy(), k2.values.to_numpy()], 1).astype("<i8").tobytes()
            gone = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
            lines = text.encode().split(b"\n")
            stay = [line for line in lines if line_key(line) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"]
        )


def _first_filters(group: pd.DataFrame) -> tuple[CuckooFilter, CuckooFilter, int]:
    if not len(group):
        return CuckooFilter.sized(0), CuckooFilter.sized(0), 0
    row = group.iloc[0]
    return CuckooFilter.read(row.held), CuckooFilter.read(row["shared"]), int(row.n_held)


def _filter_row(shard: int, held: CuckooFilter, shared: CuckooFilter, n_held: int) -> dict:
    return {"shard": shard, "held": held.written(), "shared": shared.written(), "n_held": n_held}


class LineStore:
    """The lines of a growing and shrinking set of documents, in the folder ``path``.

    A folder that holds a store already is opened at its last whole version; what a lost driver left of a newer one
    counts for nothing and is overwritten. ``shards`` is fixed when the store is made: a task holds the keys that one
    change has in one shard, and that shard's filters. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path, self.shards = spark, path, shards
        try:
            found = spark.read.parquet(f"{path}/filters").agg(F.max("v"), F.max("shards")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = (0, None)
        self.version, self.shards = found[0] or 0, found[1] or shards

    def _write(self, table: str, version: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/v={version}")

    def _read(self, table: str, schema: str) -> DataFrame:
        """All rows up to the current version, with the version ``v``."""
        columns = [c.split()[0] for c in schema.split(", ")]
        if not self.version:
            return self.spark.createDataFrame([], f"{schema}, v int")
        read = self.spark.read.schema(f"{schema}, v int").parquet(f"{self.path}/{table}")
        return read.where(F.col("v") <= self.version).select(*columns, "v")

    def _filters(self) -> DataFrame:
        return self._read("filters", f"{_FILTERS}, shards int").where(F.col("v") == self.version).drop("v", "shards")

    def references(self) -> DataFrame:
        """``(shard, k1, k2, n_docs, owner)``: the documents that hold each key, and the least id of them."""
        rows = self._read("refs", _REFS)
        if self.version > 1:
            rows = rows.groupBy("shard", "k1", "k2").agg(F.max(F.struct("v", "n_docs", "owner")).alias("x")).select("shard", "k1", "k2", "x.n_docs", "x.owner")
        return rows.where("n_docs > 0").select("shard", "k1", "k2", "n_docs", "owner")

    def _live(self) -> DataFrame:
        """The key lists of the documents that have not been deleted since."""
        rows = self._read("lines", _LINES).where(F.col("kind") == _DOC).select("doc", "k1", "k2", "v")
        if self.version > 1:
            gone = self._read("gone", "doc long").groupBy("doc").agg(F.max("v").alias("gone_v"))
            rows = rows.join(gone, "doc", "left").where("gone_v is null or gone_v < v").drop("gone_v")
        return rows.drop("v")

    @staticmethod
    def _pairs(lists: DataFrame, *columns: str) -> DataFrame:
        x = lists.select(*columns, F.explode(F.arrays_zip("k1", "k2")).alias("x"))
        return x.select(*columns, F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2"))

    def _shard(self):
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")

    def _with_room(self, filters: DataFrame, more: DataFrame) -> DataFrame:
        """The filters; those that ``more`` (shard, more) would crowd are built anew with room, from the exact table."""

        def needs(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            held, _, n_held = _first_filters(group)
            total = n_held + (int(rows.more.iloc[0]) if len(rows) else 0)
            shard = int((rows if len(rows) else group).shard.iloc[0])
            return pd.DataFrame([{"shard": shard, "room": 2 * total}] if total > held.room else [], columns=["shard", "room"])

        crowded = stored(filters.groupBy("shard").cogroup(more.groupBy("shard")).applyInPandas(needs, "shard int, room long"), "crowded")

        def build(group: pd.DataFrame) -> pd.DataFrame:
            keys, room = group.k2.to_numpy(), int(group.room.iloc[0])
            held, shared = CuckooFilter.of(keys, room), CuckooFilter.of(keys[group.n_docs.to_numpy() > 1], room)
            return pd.DataFrame([_filter_row(int(group.shard.iloc[0]), held, shared, len(keys))])

        known = self.references().join(F.broadcast(crowded), "shard")
        rebuilt = known.groupBy("shard").applyInPandas(build, _FILTERS)
        empty = crowded.join(filters.select("shard"), "shard", "left_anti")

        def fresh(batches):
            for batch in batches:
                yield pd.DataFrame([_filter_row(int(s), CuckooFilter.sized(int(r)), CuckooFilter.sized(int(r)), 0) for s, r in zip(batch.shard, batch.room)], columns=["shard", "held", "shared", "n_held"])

        same = filters.join(F.broadcast(crowded.select("shard")), "shard", "left_anti")
        return same.unionByName(rebuilt).unionByName(empty.mapInPandas(fresh, _FILTERS))

    def insert(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> None:
        """Add documents that the store doesn't hold yet. Null texts are empty; ids are whole numbers or null.

        Rows of one id are one document as far as lines are concerned: none of its rows loses a line to another. All
        rows of a null id are one document, behind all others. Deleting an id deletes all its rows.
        """
        v = self.version + 1
        read = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty(text).alias("text"))
        self._write("lines", v, read.mapInArrow(_keys_of_texts, _LINES))
        self._write("gone", v, self.spark.createDataFrame([], "doc long"))
        lines = self.spark.read.schema(_LINES).parquet(f"{self.path}/lines/v={v}")
        counted = lines.where(F.col("kind") == _COUNTS).select(F.explode(F.arrays_zip("k1", "k2", "docs", "owner")).alias("x")).select("x.*").withColumn("shard", self._shard())
        filters = self._filters()
        if self.version:
            filters = stored(self._with_room(filters, counted.groupBy("shard").agg(F.count("*").alias("more"))), "roomy_filters")

        def probe(rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            """New keys go into the filters; keys that the filter may hold wait for their exact counts. One filter row comes behind."""
            shard = int((rows if len(rows) else group).shard.iloc[0])
            held, shared, n_held = _first_filters(group)
            k1, k2, n, owner = _counted(*(rows[c].to_numpy() for c in ("k1", "k2", "docs", "owner")))
            known = held.holds(k2) if len(group) else np.zeros(len(k2), bool)
            new = ~known
            if not len(group):
                held, shared = CuckooFilter.sized(int(new.sum())), CuckooFilter.sized(int((new & (n > 1)).sum()))
            held.insert(k2[new])
            shared.insert(k2[new & (n > 1)])
            out = pd.DataFrame({"shard": np.int32(shard), "k1": k1, "k2": k2, "n_docs": n.astype(np.int64), "owner": owner, "known": known, "held": None, "shared": None, "n_held": 0})
            last = _filter_row(shard, held, shared, n_held + int(new.sum())) | {"k1": 0, "k2": 0, "n_docs": 0, "owner": 0, "known": False}
            return pd.concat([out, pd.DataFrame([last])[list(out.columns)]], ignore_index=True)

        probed = stored(
            counted.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, f"{_REFS}, known boolean, held binary, shared binary, n_held long"), "probed"
        )
        keys = probed.where("held is null").drop("held", "shared", "n_held")
        filters = probed.where("held is not null").select("shard", "held", "shared", "n_held")
        maybe = keys.where("known").drop("known")
        old = self.references().select("k1", "k2", F.col("n_docs").alias("old_n"), F.col("owner").alias("old_owner"))
        met = stored(maybe.join(old, ["k1", "k2"], "left"), "met") if self.version else None
        refs = keys.where("not known").drop("known")
        if met is not None:
            raised = met.select(
                "shard", "k1", "k2", (F.col("n_docs") + F.coalesce("old_n", F.lit(0))).alias("n_docs"), F.least("owner", "old_owner").alias("owner")
            )
            refs = refs.unionByName(raised)
            grown = met.select(
                "shard", "k2", F.when(F.col("old_n").isNull(), 1).otherwise(0).alias("held"), F.when((F.coalesce("old_n", F.lit(0)) < 2) & (F.coalesce("old_n", F.lit(0)) + F.col("n_docs") > 1), 1).otherwise(0).alias("shared")
            )
            filters = self._changed(filters, grown)
        self._commit(v, refs, filters)

    def _changed(self, filters: DataFrame, changes: DataFrame) -> DataFrame:
        """Filters after changes (shard, k2, held, shared), which are 1 for a key that goes in, -1 for one that goes out."""

        def change(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            held, shared, n_held = _first_filters(group)
            for name, kept in (("held", held), ("shared", shared)):
                kept.remove(rows.k2.to_numpy()[rows[name].to_numpy() < 0])
                kept.insert(rows.k2.to_numpy()[rows[name].to_numpy() > 0])
            return pd.DataFrame([_filter_row(int(group.shard.iloc[0]), held, shared, n_held + int(rows.held.sum()))])

        return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, _FILTERS)

    def _commit(self, v: int, refs: DataFrame, filters: DataFrame) -> None:
        """The filters come last: a version without them doesn't count, and the next change overwrites all its tables."""
        self._write("refs", v, refs.select("shard", "k1", "k2", "n_docs", "owner"))
        self._write("filters", v, filters.withColumn("shards", F.lit(self.shards)))
        self.version = v

    def delete(self, ids: DataFrame, id: str = "doc_id") -> None:
        """Take documents out, as if they had never come: counts fall, and lines find the next least owner.

        ``ids`` may repeat and may name documents that the store doesn't hold.
        """
        v = self.version + 1
        if not self.version:
            return
        gone = stored(ids.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID)).alias("doc")).distinct(), "gone_ids")
        live = self._live()
        fewer = self._pairs(live.join(gone, "doc", "left_semi")).groupBy("k1", "k2").agg(F.count("*").alias("less"))
        touched = stored(self.references().join(fewer, ["k1", "k2"]), "touched")
        rest = touched.where("n_docs > less").join(gone.withColumnRenamed("doc", "owner"), "owner", "left_semi").select("k1", "k2")
        next_owner = (
            self._pairs(live.join(gone, "doc", "left_anti"), "doc").join(rest, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("doc").alias("next_owner"))
        )
        left = F.col("n_docs") - F.col("less")
        refs = touched.join(next_owner, ["k1", "k2"], "left").select("shard", "k1", "k2", left.alias("n_docs"), F.coalesce("next_owner", "owner").alias("owner"))
        changes = touched.select("shard", "k2", F.when(left == 0, -1).otherwise(0).alias("held"), F.when((F.col("n_docs") > 1) & (left < 2), -1).otherwise(0).alias("shared"))
        filters = self._changed(self._filters(), changes)
        self._write("gone", v, gone)
        self._write("lines", v, self.spark.createDataFrame([], _LINES))
        self._commit(v, refs, filters)

    def _looked_up(self, lists: DataFrame) -> DataFrame:
        """(doc, k1, k2) of the lines that another document may hold, by the filters if these are small."""
        sizes = self._filters().agg(F.sum(F.length("shared")), F.min(F.length("shared"))).first()
        if not sizes[0] or sizes[0] > _FILTER_BYTES or not sizes[1]:
            return self._pairs(lists, "doc")
        tables = {r.shard: r["shared"] for r in self._filters().select("shard", "shared").collect()}
        sent, shards = self.spark.sparkContext.broadcast(tables), self.shards

        def probe(batches):
            filters = {shard: CuckooFilter.read(bytes(data)) for shard, data in sent.value.items()}
            for batch in batches:
                k1, k2 = (batch.column(c).flatten().to_numpy() for c in (1, 2))
                doc = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
                shard = np.mod(k1, shards)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                held = np.zeros(len(k1), bool)
                for s in np.unique(shard).tolist():
                    at = order[bounds[s] : bounds[s + 1]]
                    if s in filters:
                        held[at] = filters[s].holds(k2[at])
                yield pa.RecordBatch.from_arrays([pa.array(x[held], pa.int64()) for x in (doc, k1, k2)], ["doc", "k1", "k2"])

        return lists.select("doc", "k1", "k2").mapInArrow(probe, "doc long, k1 long, k2 long")

    def deduplicated(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``(id, n_lines, n_dropped, kept)`` for every row of ``docs``, documents that the store holds.

        Lines whose key at least two documents hold go, except in the document of the least id. Lines split at ``\\n`` alone; null and empty
        texts are one empty line; keys of under ten code points never go. Rows of a document that the store doesn't hold stay whole.
        """
        shared = stored(self.references().where("n_docs > 1").drop("shard"), "shared_keys")
        found = joined_by_frequency(self._looked_up(self._live()), shared, ["k1", "k2"], frequent(shared, "n_docs", _HOT_KEYS))
        drops = found.where("doc <> owner").groupBy("doc").agg(F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2"))
        drops = stored(drops, "dropped_keys").withColumnRenamed("doc", "doc_of_drop")
        marked = docs.select(F.col(f"`{id}`").alias("id"), text_or_empty(text).alias("text"))
        joined = marked.join(drops, F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)) == F.col("doc_of_drop"), "left")
        kind = docs.schema[id].dataType.simpleString()
        out = joined.select("id", "text", "k1", "k2").mapInArrow(_kept_lines, f"id {kind}, n_lines long, n_dropped long, kept string")
        return out.withColumnRenamed("id", id)
