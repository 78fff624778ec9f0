"""Row choice and membership by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.local import local_table


# A key is hot from this many rows on, if it also has more than a task's even share.
HOT_ROWS = 1_000_000
# Items that the sketch of frequent keys follows; its counts are off by that part of all rows at most.
_SKETCH_ITEMS = 8192
_MOST_HOT = 1024


def _listed(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def hot_keys(df: DataFrame, on: str | list[str], *, rows_per_copy: int = HOT_ROWS) -> dict[int, int]:
    """The keys that hold more rows than one task should take, by hash, with the number of tasks that should share each.

    One pass over the key columns with a frequent-items sketch, which every task keeps at a fixed size; at most 1,024 keys come to
    the driver, and no more can be hot unless all are. A key that is hot in several tables adds up over ``df`` made of their keys.
    """
    session = df.sparkSession
    listed = df.select(F.xxhash64(*_listed(on)).alias("h"), F.when(F.concat(*[F.col(c).cast("string") for c in _listed(on)]).isNotNull(), 1).alias("whole"))
    found = listed.where("whole = 1").agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {_MOST_HOT}, {_SKETCH_ITEMS})").alias("top")).first()
    share = max(rows_per_copy, found.n // int(session.conf.get("spark.sql.shuffle.partitions")))
    return {t.item: -(-t["count"] // share) for t in found.top or [] if t["count"] > share}


def spread_join(
    df: DataFrame, lookup: DataFrame, on: str | list[str], how: str, *, spread=None, hot: dict[int, int] | None = None
) -> DataFrame:
    """Join many rows to a lookup of few rows per key when one key may hold much of ``df``.

    ``hot`` says which keys do, as ``hot_keys`` measures them; it is measured here if not given. Without hot keys this
    is a plain join. The rows of a hot key take a salt from their ``spread`` columns (all but the key by default), and the lookup has as
    many copies of that key as tasks should share it, and one of every other. ``how`` keeps the rows of ``df``: inner, left,
    left_semi or left_anti.
    """
    keys = _listed(on)
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return df.join(lookup, keys, how)
    mix = list(spread) if spread is not None else [c for c in df.columns if c not in keys]
    table = local_table(df.sparkSession, _hash=list(hot), _copies=list(hot.values()))

    def marked(side: DataFrame) -> DataFrame:
        return side.withColumn("_hash", F.xxhash64(*keys)).join(table, "_hash", "left").drop("_hash")

    salt = F.coalesce(F.pmod(F.xxhash64(*mix), F.col("_copies")).cast("int"), F.lit(0)) if mix else F.lit(0)
    salted = marked(df).withColumn("_salt", salt).drop("_copies")
    last = F.coalesce(F.col("_copies").cast("int"), F.lit(1)) - 1
    copies = marked(lookup).withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_copies")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def restrict_to(df: DataFrame, keys: DataFrame, on: str | list[str] = "emplid", *, spread=None, hot=None) -> DataFrame:
    """Rows whose key occurs in ``keys``. ``hot`` as for ``spread_join``."""
    return spread_join(df, keys.select(*_listed(on)).distinct(), on, "left_semi", spread=spread, hot=hot)


def exclude(df: DataFrame, keys: DataFrame, on: str | list[str] = "emplid", *, spread=None, hot=None) -> DataFrame:
    """Rows whose key does not occur in ``keys``. ``hot`` as for ``spread_join``."""
    return spread_join(df, keys.select(*_listed(on)).distinct(), on, "left_anti", spread=spread, hot=hot)


class JoinGuard:
    """Counts the rows that go into a join and come out of it, in the job that runs the join.

    ``rows_in`` and ``rows_out`` wait for the first action over the result. A lookup with a key twice shows as more rows out than in.
    """

    def __init__(self, name: str = "join"):
        self.name = name
        self._seen: list[Observation] = []

    def _counted(self, df: DataFrame, side: str) -> DataFrame:
        self._seen.append(Observation(f"{self.name}_{side}"))
        return df.observe(self._seen[-1], F.count(F.lit(1)).alias("rows"))

    def join(self, df: DataFrame, lookup: DataFrame, on: str | list[str], how: str) -> DataFrame:
        if self._seen:
            raise ValueError("a guard counts one join")
        return self._counted(self._counted(df, "in").join(lookup, _listed(on), how), "out")

    @property
    def rows_in(self) -> int:
        return self._seen[0].get["rows"]

    @property
    def rows_out(self) -> int:
        return self._seen[1].get["rows"]

    def check(self) -> None:
        """Raise an error if the join has multiplied rows."""
        if self.rows_out > self.rows_in:
            raise ValueError(f"{self.name}: {self.rows_in} rows became {self.rows_out}, so keys of the lookup repeat")


def common_keys(a: DataFrame, b: DataFrame, on: str = "emplid") -> DataFrame:
    """Distinct keys found on both sides. Each side is made distinct in its tasks first."""
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_semi")


def keys_only_in(a: DataFrame, b: DataFrame, on: str = "emplid") -> DataFrame:
    """Distinct keys of ``a`` not found in ``b``."""
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """One row per key: the first by ``tiebreak`` and then by the other columns.

    A minimum over structs, so each task keeps one row per key before the shuffle. ``tiebreak``
    sorts NULLs first.
    """
    rest = [c for c in df.columns if c not in keys and c not in tiebreak]
    order = [c for c in tiebreak if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def repeated_keys(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Keys with more than one row: a join on them would multiply rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def count_students(df: DataFrame, student: str = "emplid", out: str = "students") -> DataFrame:
    """Number of distinct students."""
    return df.agg(F.countDistinct(student).alias(out))
