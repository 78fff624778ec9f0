"""The three batch jobs end to end: extract, eligibility, cross-tabs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .. import fixed_values as fv
from ..functions import with_class_key, with_plan_flag
from ..operators.cohort import census_cohort
from ..operators.eligibility import advance_state, matrix_of_state, student_matrix, student_matrix_v1
from ..operators.history import build_extract
from ..operators.reports import (
    eligibility_stats,
    eligible_not_enrolled,
    overlap_report,
    plan_level_table,
    student_cells,
    students_by_level,
    subplan_level_table,
)
from ..operators.rules import CURRENT_RULES
from ..operators.status import student_base, to_wide
from ..session import stored_table
from ..sources.writers import export_eligible, write_csv


def extract_batch(
    src: dict[str, DataFrame], term: str, out: str, *, plans=fv.EXTRACT_PLANS, first_term: str = fv.FIRST_TERM
) -> None:
    """Write the full extract of the cohort of ``term`` as Parquet."""
    cohort = census_cohort(src["census"], term, by="program")
    extract = with_plan_flag(build_extract(src, cohort, plans, first_term))
    extract.na.fill("").sortWithinPartitions("strm", "emplid").write.mode("overwrite").parquet(out)


def eligibility_batch(
    history: DataFrame,
    term: str,
    out: str,
    *,
    rules=CURRENT_RULES,
    tiebreak=(),
    export_targets=fv.EXPORT_TARGETS,
) -> None:
    """Write the wide table, the statistics and the lists of eligible students as CSV."""
    history = with_class_key(history)
    targets = [r.target for r in rules]
    base = student_base(history, term, tiebreak=tiebreak)
    matrix = student_matrix(history, rules, last_term=term, tiebreak=tiebreak)
    matrix = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_csv(to_wide(matrix, targets, base), f"{out}/wide")
        write_csv(eligibility_stats(matrix, targets, enrolled=f"enrolled_{term}"), f"{out}/statistics")
        export_eligible(
            eligible_not_enrolled(matrix, base, export_targets), export_targets, f"{out}/eligible_not_enrolled"
        )
    finally:
        matrix.unpersist()


def eligibility_batch_v1(history: DataFrame, term: str, out: str, *, tiebreak=(), columns=fv.BASE_COLUMNS_V1) -> None:
    """Write the older wide table as CSV: sticky status, the older counter, suffixed column names."""
    history = with_class_key(history, default="")
    names = {name.rsplit("_", 1)[0]: name for name in fv.WIDE_COLUMNS_V1}
    base = student_base(history, term, columns, tiebreak)
    matrix = student_matrix_v1(history, last_term=term)
    write_csv(to_wide(matrix, list(names), base, names=names), out)


def crosstabs(cells: DataFrame, term: str) -> dict[str, DataFrame]:
    """The level counts, the subplan overlap, and the plan and subplan tables, by name."""
    a, b = fv.TAIL_SUBPLANS
    kept = cells.where(cells["um_clevel_descr"] != fv.DROPPED_LEVEL)
    return {
        "students_by_level": students_by_level(cells, term=term),
        "overlap_totals": overlap_report(kept, a, b),
        "overlap_exclusive": overlap_report(kept, a, b, exclusive=True),
        "plan_levels": plan_level_table(cells),
        "subplan_levels": subplan_level_table(cells),
    }


def crosstab_batch(history: DataFrame, term: str, out: str) -> None:
    """Write the level counts, the subplan overlap, and the plan and subplan tables as CSV, from one scan of the history."""
    for name, table in crosstabs(stored_table(student_cells(history, term), "cells"), term).items():
        write_csv(table, f"{out}/{name}")


def eligibility_increment(history: DataFrame, term: str, state: str, out: str, *, rules=CURRENT_RULES, tiebreak=()) -> None:
    """Add the rows of one more term to the stored student state, and write the state after it and the term's matrix.

    ``state`` is the folder of the state before the term; the new one goes to ``<out>/state``. Only the term's rows of ``history`` are read.
    """
    spark, options = history.sparkSession, {"rules": rules, "tiebreak": tiebreak}
    advance_state(spark.read.parquet(state), with_class_key(history), term, **options).write.mode("overwrite").parquet(f"{out}/state")
    matrix_of_state(spark.read.parquet(f"{out}/state"), term, rules).write.mode("overwrite").parquet(f"{out}/matrix")
