"""Scans of the history, the rule table and the warehouse tables."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import coerce_number, normalise_headers
from ..session import stored_table
from .local import local_table
from .schemas import HISTORY_SCHEMA, RULE_SCHEMA, SOURCE_SCHEMAS


# Column orders that the files of one path may have.
MOST_LAYOUTS = 256
_ESCAPE = {"escape": '"'}


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The raw records of all CSV files: file, start of the split, place and text. Blank lines are none.

    With ``multi_line`` the CSV source finds where a quoted record ends. It keeps a record's text where the fields don't fit the schema, here of
    one field; a record of one field is written as it was.
    """
    if multi_line:
        one = "first_field string, record string"
        options = {**_ESCAPE, "multiLine": True, "columnNameOfCorruptRecord": "record"}
        raw = spark.read.schema(one).options(**options).csv(path)
        text = F.coalesce("record", F.to_csv(F.struct("first_field"), _ESCAPE))
    else:
        raw, text = spark.read.text(path), F.col("value")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return raw.select(*place, F.monotonically_increasing_id().alias("place"), text.alias("record")).where("trim(record) <> ''")


def _names(header: str) -> list[str]:
    """Lower-case column names of a header line; a blank name is the field's number, a repeated one gets it behind."""
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")]))):
        name = name.strip().lower() or f"_c{k}"
        names.append(f"{name}_{k}" if name in names else name)
    return names


@dataclass(frozen=True)
class CsvScan:
    """``rows`` under lower-case column names; ``bad`` holds file and record of rows with other than their header's number of fields."""

    rows: DataFrame
    bad: DataFrame


def scan_csv(spark: SparkSession, path: str, multi_line: bool = True, keep_bad: bool = True) -> CsvScan:
    """Read CSV files whose columns may come in any order and may differ; each file is read once.

    The records are stored first. Headers are the first records of the files, and only the different headers come to the driver (256 at
    most), never the paths. Columns that a file lacks are NULL. ``keep_bad`` keeps rows with too few fields, padded, or too
    many, cut, in ``rows`` too. ``multi_line`` lets quoted fields hold line ends, at the price that one file is read by one task.
    """
    records = stored_table(_records(spark, path, multi_line), "csv_records")
    first = records.where("start = 0").groupBy("file").agg(F.min("place").alias("place"))
    heads = stored_table(records.join(first, ["file", "place"]).select("file", F.col("place").alias("head"), F.col("record").alias("header")), "csv_heads")
    found = [r.header for r in heads.select("header").distinct().orderBy("header").limit(MOST_LAYOUTS + 1).collect()]
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers under {path}")
    layouts = [_names(header) for header in found]
    columns = list(dict.fromkeys(name for names in layouts for name in names))
    numbers = local_table(spark, header=pa.array(found, pa.string()), layout=pa.array(range(len(found)), pa.int32()))
    of_file = heads.join(numbers, "header").select("file", "head", "layout")
    rows = records.join(of_file, "file").where("place <> head").select("file", "record", "layout")
    options = {**_ESCAPE, "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    parsed = []
    for k, names in enumerate(layouts):
        schema = ", ".join([*(f"f{n} string" for n in range(len(names))), "bad string"])
        parsed.append(F.from_csv(F.when(F.col("layout") == k, F.col("record")), schema, options).alias(f"as{k}"))
    rows = rows.select("file", "record", *parsed)

    def value(name: str) -> Column:
        return F.coalesce(*[F.col(f"as{k}.f{names.index(name)}") for k, names in enumerate(layouts) if name in names])

    marked = [F.col(f"as{k}.bad").isNotNull() for k in range(len(layouts))]
    is_bad = reduce(or_, marked, F.lit(False))
    good = rows if keep_bad else rows.where(~is_bad)
    return CsvScan(good.select(*[value(c).alias(c) for c in columns]), rows.where(is_bad).select("file", "record"))


def _scan(spark: SparkSession, path: str, fmt: str, multi_line: bool = True, quarantine: str | None = None) -> DataFrame:
    """A table with lower-case headers. With ``quarantine``, malformed CSV rows go to a Parquet table there instead."""
    if fmt != "csv":
        return normalise_headers(spark.read.format(fmt).load(path))
    scan = scan_csv(spark, path, multi_line, keep_bad=quarantine is None)
    if quarantine is not None:
        scan.bad.write.mode("overwrite").parquet(quarantine)
    return scan.rows


def _typed(df: DataFrame, schema: StructType, keep_rest: bool = False) -> DataFrame:
    """``schema`` over ``df``: text becomes numbers where it can, NaN becomes NULL.

    ``keep_rest`` puts the other columns behind, as they are.
    """
    types = dict(df.dtypes)
    columns = []
    for field in schema.fields:
        if field.name not in types:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        column = F.col(field.name)
        if types[field.name] == "string" and field.dataType.typeName() in ("double", "integer"):
            column = coerce_number(column)
        elif types[field.name] in ("double", "float"):
            column = F.nanvl(column, F.lit(None).cast("double"))
        columns.append(column.cast(field.dataType).alias(field.name))
    if keep_rest:
        columns += [F.col(f"`{c}`") for c in df.columns if c not in schema.fieldNames()]
    return df.select(*columns)


def read_history(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType = HISTORY_SCHEMA,
    extra: list[str] | None = None,
    multi_line: bool = True,
    quarantine: str | None = None,
) -> DataFrame:
    """The long course history: lower-case headers, string ids, ``''`` for missing text.

    CSV columns are found by header, whatever their order in each file. ``extra`` names further columns to
    keep, such as tiebreak columns. Set ``multi_line`` to False for large CSV files whose fields hold no line
    ends, so that many tasks share a file. ``quarantine`` is a folder for the CSV rows with too many or too few fields, which are then
    left out here.
    """
    raw = _scan(spark, path, fmt, multi_line, quarantine)
    known = set(schema.fieldNames())
    more = [StructField(c, raw.schema[c].dataType) for c in extra or [] if c not in known]
    df = _typed(raw, StructType(schema.fields + more))
    text = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    return df.na.fill("", subset=text)


def read_rules(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The rule table. A plain ``class, condreq`` table is enough; other columns are optional."""
    raw = _scan(spark, path, fmt)
    if "class" in raw.columns and "target" not in raw.columns:
        raw = raw.withColumnsRenamed({"class": "target"})
    rules = _typed(raw, RULE_SCHEMA).withColumn("target", F.upper("target"))
    return rules.na.drop(subset=["target"])


def load_sources(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The seven warehouse tables from ``<folder>/<name>`` with all their columns.

    Columns the operators use come first, typed, and NULL where a table lacks them; text that is no number is NULL
    in a number column.
    """
    return {name: _typed(_scan(spark, f"{folder}/{name}", fmt), schema, keep_rest=True) for name, schema in SOURCE_SCHEMAS.items()}


def preview(df: DataFrame, n: int = 20, condition: Column | None = None) -> DataFrame:
    """Any ``n`` rows that meet ``condition``, for a look at a table."""
    return (df if condition is None else df.where(condition)).limit(n)
