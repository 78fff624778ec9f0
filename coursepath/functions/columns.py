"""Column expressions shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as fv


def clean_catalog_nbr(nbr: Column, default: str = fv.CATALOG_DEFAULT) -> Column:
    """First run of four digits (``_0110`` -> ``0110``, ``12345W`` -> ``1234``), else ``default``."""
    digits = F.regexp_extract(nbr, r"(\d{4})", 1)
    return F.when(digits != "", digits).otherwise(F.lit(default))


def class_key(subject: Column, nbr: Column, default: str = fv.CATALOG_DEFAULT) -> Column:
    """``SUBJECT_NNNN`` in upper case; blank parts never make the key NULL."""
    blank = F.lit("")
    return F.upper(
        F.concat(F.coalesce(subject, blank), F.lit("_"), clean_catalog_nbr(F.coalesce(nbr, blank), default))
    )


def with_class_key(
    df: DataFrame,
    default: str = fv.CATALOG_DEFAULT,
    subject: str = "subject",
    nbr: str = "catalog_nbr",
    out: str = "class",
) -> DataFrame:
    return df.withColumn(out, class_key(F.col(subject), F.col(nbr), default))


def with_plan_flag(
    df: DataFrame, plans=fv.MAJOR_PLANS, plan: str = "acad_plan", out: str = "bus_maj"
) -> DataFrame:
    """1 where the plan is one of ``plans``, else 0."""
    return df.withColumn(out, F.coalesce(F.col(plan).isin(*plans), F.lit(False)).cast("int"))


def coerce_number(text: Column) -> Column:
    """Double, or NULL for anything that is not a number. NaN counts as missing.

    The pattern comes first because the JVM parser also takes Java suffixes such as ``1d``, and
    raises an exception inside for every bad value.
    """
    number = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
    return F.when(text.rlike(number), text.try_cast("double"))


def not_nan(number: Column) -> Column:
    """NaN as NULL. Spark sorts NaN above every number, so an unchecked NaN would pass as large."""
    return F.when(~F.isnan(number), number)


def strip_suffix(name: Column) -> Column:
    """Drop the part after the last underscore: ``BUS_AD_1500_28`` -> ``BUS_AD_1500``."""
    return F.when(name.contains("_"), F.regexp_extract(name, r"^(.*)_[^_]*$", 1)).otherwise(name)


def suffix_of(name: Column) -> Column:
    """The part after the last underscore, blank if there is none."""
    return F.when(name.contains("_"), F.regexp_extract(name, r"_([^_]*)$", 1)).otherwise(F.lit(""))


def any_of_equals(columns: list[str], value: str) -> Column:
    """``c1 = v OR c2 = v ...`` with SQL's three-valued logic."""
    return reduce(or_, [F.col(c) == value for c in columns])


def level_or_label(level: Column, label: str = fv.NO_LEVEL_LABEL) -> Column:
    """Class level, or a label where the census has no record for the term."""
    return F.coalesce(level, F.lit(label))


def normalise_headers(df: DataFrame, case: str = "lower") -> DataFrame:
    """All column names in ``lower`` or ``upper`` case."""
    return df.toDF(*[getattr(c, case)() for c in df.columns])


def pad_to(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
