"""Statistics per target, lists of eligible students, and student counts by level and plan."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..sources.local import local_table


def _waiting() -> Column:
    """Eligible for at least one term and never enrolled."""
    return (F.col("status") == 0) & (F.col("sem_eli") > 0)


def eligibility_stats(
    matrix: DataFrame, targets, *, enrolled: str = "enrolled_last_term", digits: int | None = 2
) -> DataFrame:
    """Per target: mean and sample SD of the waiting terms, students waiting, students enrolled.

    Sums of whole numbers are exact, so the result does not depend on how rows were combined.
    Targets without rows report zeros, and one waiting student has an SD of 0. ``digits`` None
    leaves the figures unrounded.
    """
    terms = F.when(_waiting(), F.col("sem_eli").cast("long"))
    sums = matrix.groupBy("target").agg(
        F.count(terms).alias("n"),
        F.sum(terms).cast("double").alias("total"),
        F.sum(terms * terms).cast("double").alias("squares"),
        F.count(F.when(F.col("status") == 1, 1)).alias("enrolled"),
    )
    n, total, squares = F.col("n").cast("double"), F.col("total"), F.col("squares")
    mean = F.when(F.col("n") > 0, total / n).otherwise(0.0)
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(spread / (n - 1))).otherwise(0.0)
    if digits is not None:
        mean, sd = F.bround(mean, digits), F.bround(sd, digits)
    names = list(dict.fromkeys(targets))
    listed = local_table(matrix.sparkSession, target=names, ord=list(range(len(names))))
    return (
        listed.join(sums, "target", "left")
        .na.fill(0, subset=["n", "total", "squares", "enrolled"])
        .orderBy("ord")
        .select(
            "target",
            mean.alias("mean_terms"),
            sd.alias("sd"),
            F.col("n").alias("elig_never_enrolled"),
            F.col("enrolled").alias(enrolled),
        )
    )


def eligible_not_enrolled(matrix: DataFrame, base: DataFrame, targets=fv.EXPORT_TARGETS) -> DataFrame:
    """Base columns with status and counter of every waiting student, per target."""
    waiting = matrix.where(F.col("target").isin(*targets) & _waiting())
    return base.join(waiting, "emplid").select(*base.columns, "target", "status", "sem_eli")


def level_order(spark, levels) -> DataFrame:
    """The levels with their place in the fixed order."""
    levels = list(levels)
    return local_table(spark, level=levels, level_ord=list(range(len(levels))))


def complete_levels(counts: DataFrame, levels, level: str = "level") -> DataFrame:
    """One row per listed level in the fixed order; absent ones count 0, others are left out."""
    order = level_order(counts.sparkSession, levels).withColumnsRenamed({"level": level})
    joined = order.join(counts, level, "left")
    return joined.na.fill(0).orderBy("level_ord").select(*counts.columns)


def students_by_level(
    df: DataFrame, levels=fv.UNDERGRAD_LEVELS, term: str | None = None, level: str = "um_clevel_descr"
) -> DataFrame:
    """Distinct students per class level, of one term or of all."""
    rows = df if term is None else df.where(F.col("strm") == term)
    rows = rows.where(F.col(level).isin(*levels)).select(F.col(level).alias("level"), "emplid")
    counts = rows.groupBy("level").agg(F.countDistinct("emplid").alias("students"))
    return complete_levels(counts, levels)


def students_by_level_sorted(df: DataFrame, levels=fv.REPORT_LEVELS, level: str = "um_clevel_descr") -> DataFrame:
    """Distinct students per class level, most first."""
    counts = students_by_level(df, levels, level=level)
    order = level_order(df.sparkSession, levels)
    return counts.join(order, "level").orderBy(F.desc("students"), "level_ord").select("level", "students")


def crosstab_students(
    df: DataFrame, row: str, values=fv.REPORT_LEVELS, col: str = "um_clevel_descr", names=None
) -> DataFrame:
    """Distinct students per ``row`` value, one column per listed level, 0 where there are none.

    Duplicates go in each task before the shuffle. A row value seen only at unlisted levels
    keeps its row, with zeros.
    """
    names = names or [v.lower().replace(" ", "_") for v in values]
    cell = F.when(F.col(col).isin(*values), F.col(col)).alias("cell")
    seen = df.select(F.col(row), cell, "emplid").distinct()
    return seen.groupBy(row).agg(
        *[F.count(F.when(F.col("cell") == v, 1)).alias(name) for v, name in zip(values, names)]
    )


def student_cells(
    df: DataFrame, term: str, *, plan: str = "acad_plan", subplan: str = "acad_subplan", level: str = "um_clevel_descr"
) -> DataFrame:
    """The distinct combinations of student, level, plan and subplan, with ``strm`` where one is of ``term``.

    Every count of distinct students by these is the same over the cells as over the history, and there are as many cells as a student
    has had combinations. Store them, and all cross-tabs come from one scan of the history.
    """
    cells = df.groupBy("emplid", level, plan, subplan).agg(F.max(F.when(F.col("strm") == term, 1).otherwise(0)).alias("now"))
    return cells.withColumn("strm", F.when(F.col("now") == 1, F.lit(term))).drop("now")


def with_row_total(df: DataFrame, columns, out: str = "total") -> DataFrame:
    """Sum across columns. Over levels it counts a student once per level, so it is not a distinct count."""
    return df.withColumn(out, reduce(add, [F.col(c) for c in columns]))


def order_with_tail(df: DataFrame, column: str, tail=fv.TAIL_SUBPLANS) -> DataFrame:
    """Sorted by ``column``, with the ``tail`` values last in the given order."""
    place = F.lit(0)
    for i, value in enumerate(tail, start=1):
        place = F.when(F.col(column) == value, i).otherwise(place)
    return df.orderBy(place, column)


def plan_level_table(
    df: DataFrame, plans=fv.REPORT_PLANS, levels=fv.REPORT_LEVELS, plan: str = "acad_plan"
) -> DataFrame:
    """Students per plan and level with a row total, in the order of ``plans``; None takes every plan, by name."""
    rows = df.where(F.col("um_clevel_descr") != fv.DROPPED_LEVEL)
    if plans is not None:
        rows = rows.where(F.col(plan).isin(*plans))
    table = crosstab_students(rows, plan, levels)
    place = F.array_position(F.array(*map(F.lit, plans)), F.col(plan)) if plans is not None else F.col(plan)
    return with_row_total(table, table.columns[1:]).orderBy(place)


def subplan_level_table(
    df: DataFrame, levels=fv.REPORT_LEVELS, subplan: str = "acad_subplan", *, drop_blank: bool = False
) -> DataFrame:
    """Students per subplan and level with a row total, named subplans last, empty rows left out."""
    rows = df.where(F.col("um_clevel_descr") != fv.DROPPED_LEVEL)
    if drop_blank:
        rows = rows.where(F.col(subplan) != "")
    table = crosstab_students(rows, subplan, levels)
    table = with_row_total(table, table.columns[1:]).where(F.col("total") > 0)
    return order_with_tail(table, subplan)


def overlap_report(
    df: DataFrame,
    a: str,
    b: str,
    *,
    col: str = "acad_subplan",
    levels=fv.REPORT_LEVELS,
    exclusive: bool = False,
    level: str = "um_clevel_descr",
) -> DataFrame:
    """Students of ``a``, of ``b`` and of both, per level.

    Membership comes from any row of a student; all of the student's rows are then counted. The
    totals form lets ``a`` and ``b`` overlap with both and adds a row of distinct students, also
    those at unlisted levels. The exclusive form splits them and adds a total column.
    """
    levels = list(levels)
    name = F.col(col)
    students = df.groupBy("emplid").agg(
        F.max(F.when(name == a, 1).otherwise(0)).alias("in_a"),
        F.max(F.when(name == b, 1).otherwise(0)).alias("in_b"),
        *[F.max(F.when(F.col(level) == v, 1).otherwise(0)).alias(f"at{i}") for i, v in enumerate(levels)],
    )
    in_a, in_b = F.col("in_a") == 1, F.col("in_b") == 1
    if exclusive:
        groups = {"a_only": in_a & ~in_b, "b_only": in_b & ~in_a, "both": in_a & in_b}
    else:
        groups = {"a_total": in_a, "b_total": in_b, "both": in_a & in_b}
    at = {v: F.col(f"at{i}") == 1 for i, v in enumerate(levels)}
    if not exclusive:
        at["TOTAL_UNIQUE"] = F.lit(True)
    cells = students.where(in_a | in_b).agg(
        *[
            F.count(F.when(here & group, 1)).alias(f"{g}_{i}")
            for i, here in enumerate(at.values())
            for g, group in groups.items()
        ]
    )
    rows = cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("level"), *[F.col(f"{g}_{i}").alias(g) for g in groups])
                    for i, v in enumerate(at)
                ]
            )
        )
    )
    return with_row_total(rows, groups, "total_unique") if exclusive else rows


def level_counts_of(
    df: DataFrame, students: DataFrame, levels=fv.REPORT_LEVELS, level: str = "um_clevel_descr"
) -> DataFrame:
    """Distinct students per level among a given set of students."""
    seen = df.where(F.col(level).isin(*levels)).select(F.col(level).alias("level"), "emplid").distinct()
    chosen = seen.join(students.select("emplid").distinct(), "emplid", "left_semi")
    return complete_levels(chosen.groupBy("level").agg(F.count(F.lit(1)).alias("students")), levels)
