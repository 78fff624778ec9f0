"""Census cohorts and listings, admissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import any_of_equals

PROGRAM_SLOTS = ["um_acad_prog1", "um_acad_prog2", "um_acad_prog3", "um_acad_prog4"]


def _census_rows(census: DataFrame, term: str, career: str, college: str) -> DataFrame:
    return census.where(
        (F.col("strm") == term)
        & (F.col("acad_career") == career)
        & (F.col("um_deg_seeking") == "Y")
        & (F.col("um_acad_grp_descr") == college)
    )


def census_cohort(
    census: DataFrame,
    term: str,
    by: str = "group",
    *,
    career: str = fv.CAREER,
    college: str = fv.COLLEGE,
    program: str = fv.PROGRAM,
    levels=None,
) -> DataFrame:
    """Distinct degree-seeking students of the reference term.

    ``group`` takes them by career and college, ``program`` by a program in any of the four
    slots. ``levels`` narrows either to some class levels.
    """
    if by == "group":
        rows = _census_rows(census, term, career, college)
    elif by == "program":
        rows = census.where(
            (F.col("strm") == term)
            & (F.col("um_deg_seeking") == "Y")
            & any_of_equals(PROGRAM_SLOTS, program)
        )
    else:
        raise ValueError(f"unknown cohort rule: {by}")
    if levels is not None:
        rows = rows.where(F.col("um_clevel_descr").isin(*levels))
    return rows.select("emplid").distinct()


def census_listing(
    census: DataFrame,
    term: str,
    n: int = 50,
    *,
    columns=fv.CENSUS_LISTING_COLUMNS,
    order_by: str = "admit_term",
    tiebreak=("emplid",),
    career: str = fv.CAREER,
    college: str = fv.COLLEGE,
) -> DataFrame:
    """Census detail of the cohort, the ``n`` latest by ``order_by``; missing values come first.

    ``columns`` of None gives all columns of the table.
    """
    rows = _census_rows(census, term, career, college)
    top = rows.orderBy(F.desc_nulls_first(order_by), *[F.asc_nulls_last(c) for c in tiebreak]).limit(n)
    return top if columns is None else top.select(*columns)


def earliest_admit(
    admissions: DataFrame,
    *,
    types=fv.ADMIT_TYPES,
    career: str = fv.CAREER,
    group: str = fv.ACAD_GROUP,
) -> DataFrame:
    """Each student's earliest admit term with its label; a missing term only if there is no other."""
    term, label = F.col("admit_term_rollup"), F.col("admit_term_rollup_descrshort")
    order = F.struct(term.isNull().alias("m"), term.alias("t"), label.isNull().alias("n"), label.alias("l"))
    return (
        _admitted(admissions, types, career, group)
        .groupBy("emplid")
        .agg(F.min(order).alias("_first"))
        .select(
            "emplid",
            F.col("_first.t").alias("admit_term_rollup"),
            F.col("_first.l").alias("admit_term_rollup_descrshort"),
        )
    )


def admissions_list(
    admissions: DataFrame,
    types=fv.ADMIT_TYPES,
    group: str = fv.ACAD_GROUP,
    *,
    career: str = fv.CAREER,
    columns=(
        "admit_term_rollup", "admit_term_rollup_descrshort", "emplid", "admit_type",
        "um_deg_seeking", "ever_admit", "is_deposit_paid", "is_cancel",
    ),
) -> DataFrame:
    """Distinct degree-seeking admissions of the given types and group."""
    return _admitted(admissions, types, career, group).select(*columns).distinct()


def _admitted(admissions: DataFrame, types, career: str, group: str) -> DataFrame:
    return admissions.where(
        (F.col("um_deg_seeking") == "Y")
        & (F.col("acad_career") == career)
        & F.col("admit_type").isin(*types)
        & (F.col("acad_group") == group)
    )
