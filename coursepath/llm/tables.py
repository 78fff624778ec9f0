"""Intermediate tables in the cluster's shared folder, and small shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursepath.session import scratch_path


def new_path(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    if path is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files no executor owns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, whatever the letter case."""
    used = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in used:
        n += 1
        name = f"{base}_{n}"
    return name


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


BROADCAST_ROWS = 1_000_000  # ids of up to 16 bytes


def without(df: DataFrame, gone: DataFrame, match: Column) -> DataFrame:
    """``df`` without the rows that match a row of ``gone``, a table of ids, broadcast only if it is small."""
    gone = stored(gone, "gone")
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, match, "left_anti")


def frequent(table: DataFrame, weight: str, most: int) -> Column:
    """Whether a row's ``weight`` (a positive number) is so high that at most ``most`` rows have as high a one.

    Decided by powers of two, so the driver sees some sixty counts at most, whatever the table's size.
    """
    power = F.floor(F.log2(F.col(weight).cast("double"))).cast("int")
    seen, edge = 0, None
    for p, n in sorted(((r[0], r[1]) for r in table.groupBy(power).agg(F.count("*")).collect()), reverse=True):
        seen += n
        if seen > most:
            break
        edge = p
    return F.lit(False) if edge is None else power >= edge


def joined_by_frequency(rows: DataFrame, lookup: DataFrame, key: str | list[str], is_hot: Column) -> DataFrame:
    """Inner join with a lookup of one row per key, whose frequent keys are broadcast and whose others are shuffled.

    ``is_hot`` marks a bounded number of lookup rows (see ``frequent``). Their rows, which may be most of all, stay in
    their tasks, so no hot key is dealt to one task and only rows of rare keys are shuffled.
    """
    hot = F.broadcast(lookup.where(is_hot))
    keys = [key] if isinstance(key, str) else key
    rare = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.where(~is_hot), keys)
    return rows.join(hot, keys).unionByName(rare)
