"""Class roll-ups and one student's classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .history import _enrolled, attach_class

CLASS_COLUMNS = [
    "strm", "term", "acad_group", "acad_group_ldesc", "subject", "catalog_nbr", "class_nbr",
    "session_code", "class_section", "class_ldesc",
]
CLASS_ORDER = ["strm", "subject", "catalog_nbr", "class_section"]


def _class_attributes(class_dim: DataFrame) -> DataFrame:
    return class_dim.withColumnsRenamed({"strm_sdesc": "term"}).select(*CLASS_COLUMNS)


def class_rollup(
    enrolment: DataFrame, class_dim: DataFrame, term: str, group: str | None = fv.ACAD_GROUP
) -> DataFrame:
    """Distinct students and total credits per class section of one term."""
    classes = _class_attributes(class_dim)
    if group is not None:
        classes = classes.where(F.col("acad_group") == group)
    rows = _enrolled(enrolment, repeats=False).where(F.col("strm") == term)
    return (
        attach_class(rows.select("emplid", "strm", "class_nbr", "unt_taken"), classes, "inner")
        .groupBy(*CLASS_COLUMNS)
        .agg(F.countDistinct("emplid").alias("enrl_tot"), F.sum("unt_taken").alias("tot_credits"))
        .orderBy(*CLASS_ORDER)
    )


def student_classes(
    enrolment: DataFrame, class_dim: DataFrame, term: str, emplid: str | None = None
) -> DataFrame:
    """Distinct enrolment rows of one term with the class attributes, of one student or of all."""
    rows = _enrolled(enrolment, repeats=False).where(F.col("strm") == term)
    if emplid is not None:
        rows = rows.where(F.col("emplid") == emplid)
    found = attach_class(rows, _class_attributes(class_dim), "inner").distinct()
    # The student last, so that one popular class is not one range of the sort.
    return found.orderBy(*CLASS_ORDER, "emplid", "class_nbr")


def latest_description(
    class_dim: DataFrame, column: str = "subject_ldesc", keys=("crse_id", "subject", "catalog_nbr")
) -> DataFrame:
    """The greatest description per course."""
    return class_dim.groupBy(*keys).agg(F.max(column).alias(column))
