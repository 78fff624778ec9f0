"""Last-term base and the status of every target course: 0 not taken, 1 attempted, 2 done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import not_nan
from .bits import named, quoted
from .keys import first_per_key


def student_base(df: DataFrame, term: str, columns=fv.BASE_COLUMNS, tiebreak=()) -> DataFrame:
    """One row per student of ``term``: the first by ``tiebreak``, with the constant columns."""
    rows = df.where(F.col("strm") == term).select(*dict.fromkeys([*columns, *tiebreak]))
    return first_per_key(rows, ["emplid"], list(tiebreak)).select(*columns)


def status_code(mode: str = "latest", points: str = "grd_pts_per_unit", grade: str = "crse_grade_input") -> Column:
    """Status of one history row.

    ``latest``: a failing grade counts as done, anything without points as attempted.
    ``sticky``: zero points is attempted; rows without usable points are NULL.
    """
    p = not_nan(F.col(points))
    if mode == "latest":
        failed = (p == 0) & (F.upper(F.col(grade)) == fv.FAIL_GRADE)
        return F.when((p > 0) | failed, 2).otherwise(1)
    if mode == "sticky":
        return F.when(p > 0, 2).when(p == 0, 1)
    raise ValueError(f"unknown mode: {mode}")


def long_rows(targets, prefixes: dict[str, str]) -> Column:
    """Explode wide target columns into rows: ``target`` and, per name, the ``<prefix><target>`` column."""
    rows = [
        "named_struct('target', "
        + ", ".join([quoted(t), *[f"{quoted(name)}, {named(prefix + t)}" for name, prefix in prefixes.items()]])
        + ")"
        for t in targets
    ]
    return F.expr(f"inline(array({', '.join(rows)}))")


def in_base(df: DataFrame, base: DataFrame | None) -> DataFrame:
    """Students of the base. Without one, those the row flag ``in_base`` marks.

    With a base, every student of it stays, also one without rows here.
    """
    if base is None:
        return df.where("in_base = 1").drop("in_base")
    return base.select("emplid").distinct().join(df.drop("in_base"), "emplid", "left")


def base_flag(last_term: str | None, base: DataFrame | None) -> Column:
    """1 on rows of the last term; the base, when given, decides instead."""
    if (last_term is None) == (base is None):
        raise ValueError("give either last_term or base")
    return F.lit(0) if base is not None else F.when(F.col("strm") == last_term, 1).otherwise(0)


def status_wide(
    df: DataFrame,
    targets,
    *,
    last_term: str | None = None,
    base: DataFrame | None = None,
    mode: str = "latest",
    tiebreak=(),
    points: str = "grd_pts_per_unit",
    grade: str = "crse_grade_input",
    prefix: str = "s_",
) -> DataFrame:
    """One row per base student with a status column ``s_<target>`` per target.

    First the value per student and target, then one row per student: both aggregate in each
    task before they shuffle. Rows of other courses count only for membership in the base.
    """
    targets = list(dict.fromkeys(targets))
    is_target = F.col("class").isin(*targets)
    flag = base_flag(last_term, base)
    rows = df.where(is_target | (flag == 1)).select(
        "emplid",
        F.when(is_target, F.col("class")).alias("target"),
        flag.alias("in_base"),
        F.when(is_target, status_code(mode, points, grade)).alias("status"),
        *dict.fromkeys(["strm", *tiebreak]),
    )
    if mode == "latest":
        # The last write wins; ties beyond the tiebreak columns take the higher status.
        last = F.max(F.struct("strm", *[c for c in tiebreak if c != "strm"], "status"))["status"]
    else:
        last = F.max("status")
    per_target = rows.groupBy("emplid", "target").agg(last.alias("status"), F.max("in_base").alias("in_base"))
    per_student = per_target.groupBy("emplid").agg(
        F.max("in_base").alias("in_base"),
        *[F.expr(f"max(IF(target = {quoted(t)}, status, NULL))").alias(prefix + t) for t in targets],
    )
    return in_base(per_student, base).na.fill(0, subset=[prefix + t for t in targets])


def course_status(df: DataFrame, targets, **options) -> DataFrame:
    """``(emplid, target, status)`` for every base student and target. Options as for ``status_wide``."""
    wide = status_wide(df, targets, **options)
    targets = list(dict.fromkeys(targets))
    return wide.select("emplid", long_rows(targets, {"status": "s_"}))


def to_wide(
    matrix: DataFrame,
    targets,
    base: DataFrame | None = None,
    *,
    names: dict[str, str] | None = None,
    count_suffix: str = "_SEM_ELI",
) -> DataFrame:
    """One row per student, a column per target and, if the matrix has counters, one per counter.

    ``base`` puts its columns in front; ``names`` gives targets another column name.
    """
    columns, has_counts = [], "sem_eli" in matrix.columns
    for t in targets:
        name, mine = (names or {}).get(t, t), f"target = {quoted(t)}"
        columns.append(F.expr(f"max(IF({mine}, status, NULL))").alias(name))
        if has_counts:
            columns.append(F.expr(f"max(IF({mine}, sem_eli, NULL))").alias(name + count_suffix))
    wide = matrix.groupBy("emplid").agg(*columns)
    return wide if base is None else base.join(wide, "emplid", "left").na.fill(0, subset=wide.columns[1:])


def status_totals(matrix: DataFrame) -> DataFrame:
    """How many cells are done (2) and how many attempted (1)."""
    return matrix.agg(
        F.count(F.when(F.col("status") == 2, 1)).alias("passed"),
        F.count(F.when(F.col("status") == 1, 1)).alias("attempted"),
    )


def taken_targets(matrix: DataFrame) -> DataFrame:
    """The targets each student has taken or attempted, sorted; students with none are left out."""
    return (
        matrix.where(F.col("status") > 0)
        .groupBy("emplid")
        .agg(F.array_sort(F.collect_set("target")).alias("targets"))
    )
