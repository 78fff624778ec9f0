"""Course history from enrolment, transfer credit and test credit; schedule and full extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .. import fixed_values as fv
from ..functions import pad_to
from ..session import stored_table
from .cohort import earliest_admit
from .keys import JoinGuard, hot_keys, restrict_to, spread_join

_ARM_SCHEMA = StructType(
    [
        StructField(name, DoubleType() if name in ("grd_pts_per_unit", "unt_taken", "grade_points") else StringType())
        for name in (
            "emplid", "crse_id", "subject", "catalog_nbr", "crse_grade_off", "strm", "acad_prog",
            "crse_grade_input", "grd_pts_per_unit", "unt_taken", "grade_points", "class_nbr",
            "course_source",
        )
    ]
)

EXTRACT_COLUMNS = [
    "emplid", "strm", "term", "course_source", "admit_term", "admit_term_desc", "um_clevel_descr",
    "acad_prog", "acad_plan", "acad_subplan", "subject", "catalog_nbr", "class_nbr",
    "crse_grade_input", "grd_pts_per_unit", "unt_taken", "unt_taken_prgrss", "grade_points",
    "cum_gpa", "tot_cumulative", "tot_hrs_life",
]

SCHEDULE_COLUMNS = [
    "emplid", "strm", "term", "admit_term", "admit_term_desc", "last_upd_dt_stmp",
    "um_clevel_descr", "acad_prog", "acad_plan", "acad_subplan", "subject", "catalog_nbr",
    "class_nbr", "crse_grade_input", "grd_pts_per_unit", "unt_taken", "unt_taken_prgrss",
    "grade_points", "cum_gpa", "tot_cumulative", "tot_hrs_life",
]

# Behind student and term in an ordered extract, so that one student's rows are not one range of the sort.
_TAIL = ["subject", "catalog_nbr", "class_nbr", "acad_plan", "acad_subplan"]


def attach_class(
    enrolment: DataFrame, class_dim: DataFrame, how: str = "left", guard: JoinGuard | None = None
) -> DataFrame:
    """Class attributes by class number and term. Both keys are needed: numbers recur across terms.

    A ``guard`` counts the rows in and out, so that a class listed twice is noticed in the job that joins it.
    """
    if guard is not None:
        return guard.join(enrolment, class_dim, ["class_nbr", "strm"], how)
    return enrolment.join(class_dim, ["class_nbr", "strm"], how)


def course_catalog(class_dim: DataFrame) -> DataFrame:
    """Distinct course id, subject and number, so that credit rows join without fan-out."""
    return class_dim.select("crse_id", "subject", "catalog_nbr").distinct()


def with_lifetime_max(
    df: DataFrame, column: str = "tot_cumulative", out: str = "tot_hrs_life", student: str = "emplid", hot=None
) -> DataFrame:
    """Each student's maximum of ``column`` on every row.

    Aggregate and join rather than a window: the maximum is taken in each task first, and the
    rows of a student with very many are spread over tasks. ``hot`` as for ``spread_join``.
    """
    most = df.groupBy(student).agg(F.max(column).alias(out))
    return spread_join(df, most, student, "left", hot=hot).select(*df.columns, out)


def _enrolled(enrolment: DataFrame, *, repeats: bool = True) -> DataFrame:
    """Enrolled, graded rows; ``repeats`` also drops the excluded repeats. NULL codes drop too."""
    kept = (
        (F.col("stdnt_enrl_status") == fv.ENROLLED)
        & (F.col("enrl_status_reason") == fv.ENROLLED_REASON)
        & (F.col("grading_basis_enrl") != fv.EXCLUDED_BASIS)
    )
    if repeats:
        kept = kept & (F.col("repeat_code") != fv.EXCLUDED_REPEAT)
    return enrolment.where(kept)


def _granted(credit: DataFrame, grades) -> DataFrame:
    """Accepted credit rows, with the articulation term as the term."""
    kept = F.col("trnsfr_stat").isin(*fv.CREDIT_STATUS)
    if grades is not None:
        kept = kept & F.col("crse_grade_off").isin(*grades)
    return credit.where(kept).withColumnsRenamed({"articulation_term": "strm"})


def hot_students(src: dict[str, DataFrame]) -> dict[int, int]:
    """Students with very many rows in the course facts, measured in one pass over their student columns.

    Progress and census have a few rows per student and term, so the course facts decide.
    """
    facts = [src[name].select("emplid") for name in ("enrolment", "transfer", "test_credit")]
    return hot_keys(reduce(DataFrame.unionByName, facts), "emplid")


def _in_cohort(df: DataFrame, cohort: DataFrame | None, spread: list[str], hot) -> DataFrame:
    return df if cohort is None else restrict_to(df, cohort, spread=spread, hot=hot)


def course_history(
    src: dict[str, DataFrame], cohort: DataFrame | None = None, first_term: str = fv.FIRST_TERM, hot=None
) -> DataFrame:
    """Enrolled, transfer and test-credit courses in one tagged table (UNION ALL).

    Credit rows carry the points sentinel and NULL in the columns only enrolment has. ``hot`` are the students
    with very many rows (see ``hot_students``), measured if not given.
    """
    if cohort is not None and hot is None:
        hot = hot_students(src)
    catalog = course_catalog(src["class_dim"])
    classes = src["class_dim"].select("class_nbr", "strm", "crse_id", "subject", "catalog_nbr")

    enrolled = _in_cohort(_enrolled(src["enrolment"]).where(F.col("strm") >= first_term), cohort, ["strm", "class_nbr"], hot)
    arms = [
        attach_class(enrolled, classes, "inner").withColumn("course_source", F.lit(fv.SOURCE_ENROLLED))
    ]
    for name, tag, grades in (
        ("transfer", fv.SOURCE_TRANSFER, fv.CREDIT_GRADES),
        ("test_credit", fv.SOURCE_TEST, None),
    ):
        credit = _in_cohort(_granted(src[name], grades), cohort, ["strm", "crse_id"], hot).join(catalog, "crse_id")
        arms.append(
            credit.withColumn("course_source", F.lit(tag)).withColumn("grd_pts_per_unit", F.lit(fv.CREDIT_POINTS))
        )
    enrolled_arm, transfer_arm, test_arm = [pad_to(arm, _ARM_SCHEMA) for arm in arms]
    return enrolled_arm.unionByName(transfer_arm).unionByName(test_arm)


def course_history_by_subject(
    src: dict[str, DataFrame], subjects=fv.BUSINESS_SUBJECTS, terms: Column | None = None
) -> DataFrame:
    """Distinct courses of some subjects from all three sources (UNION).

    ``terms`` is a condition on ``strm``; by default every term from the first on.
    """
    in_subjects = src["class_dim"].where(F.col("subject").isin(*subjects))
    by_class = in_subjects.select("class_nbr", "strm", "crse_id", "subject", "catalog_nbr")
    catalog = course_catalog(in_subjects)
    columns = [
        "strm", "emplid", "crse_id", "subject", "catalog_nbr", "crse_grade_off",
        "stdnt_enrl_status", "enrl_status_reason",
    ]
    history = attach_class(_enrolled(src["enrolment"]), by_class, "inner").select(*columns)
    for name, grades in (("transfer", fv.CREDIT_GRADES), ("test_credit", None)):
        credit = _granted(src[name], grades).join(catalog, "crse_id")
        for absent in ("stdnt_enrl_status", "enrl_status_reason"):
            credit = credit.withColumn(absent, F.lit(None).cast("string"))
        history = history.unionByName(credit.select(*columns))
    return history.where(F.col("strm") >= fv.FIRST_TERM if terms is None else terms).distinct()


_TERM_COLUMNS = [
    "emplid", "strm", "term", "acad_plan", "acad_subplan", "unt_taken_prgrss", "cum_gpa",
    "tot_cumulative", "um_clevel_descr",
]


def _student_terms(rows: DataFrame, cohort: DataFrame, admissions: DataFrame, admit: str, hot) -> DataFrame:
    """Progress rows of the cohort with the admit term. ``admit`` is the join type."""
    admits = earliest_admit(admissions).withColumnsRenamed(
        {"admit_term_rollup": "admit_term", "admit_term_rollup_descrshort": "admit_term_desc"}
    )
    students = cohort.select("emplid").distinct().join(admits, "emplid", admit)
    spread = ["strm", "acad_plan", "acad_subplan"]
    return spread_join(rows.select(*_TERM_COLUMNS), students, "emplid", "inner", spread=spread, hot=hot)


def _with_lifetime_hours(joined: DataFrame, columns: list[str], hot) -> DataFrame:
    """Lifetime hours count only terms that have a course row, so they are read off the joined rows.

    These are stored first: every fact is then evaluated once, and the hours come from two of the stored columns.
    """
    rows = stored_table(joined.select(*[c for c in columns if c != "tot_hrs_life"]), "extract")
    return with_lifetime_max(rows, hot=hot).select(*columns)


def build_extract(
    src: dict[str, DataFrame],
    cohort: DataFrame,
    plans=fv.EXTRACT_PLANS,
    first_term: str = fv.FIRST_TERM,
    *,
    ordered: bool = False,
    hot: dict[int, int] | None = None,
) -> DataFrame:
    """The full extract: course history with progress, earliest admit term and class level.

    Each source of courses is restricted to the cohort before it meets its classes. The student-term attributes are put
    together apart from that, and the course rows meet them in one join, whose result is stored when this is called. ``ordered`` sorts
    by student and term; ``hot`` as for ``course_history``.
    """
    hot = hot_students(src) if hot is None else hot
    courses = course_history(src, cohort, first_term, hot)
    levels = src["census"].select("emplid", "strm", "um_clevel_descr")
    rows = src["progress"].where(F.col("acad_plan").isin(*plans)).join(levels, ["emplid", "strm"], "left")
    terms = _student_terms(rows, cohort, src["admissions"], "left", hot)
    distinct = courses.join(terms, ["emplid", "strm"]).select(*[c for c in EXTRACT_COLUMNS if c != "tot_hrs_life"]).distinct()
    extract = _with_lifetime_hours(distinct, EXTRACT_COLUMNS, hot)
    return extract.orderBy("emplid", "strm", *_TAIL) if ordered else extract


def build_schedule(
    src: dict[str, DataFrame],
    cohort: DataFrame,
    plans=fv.EXTRACT_PLANS,
    levels=fv.UNDERGRAD_LEVELS,
    *,
    ordered: bool = False,
    hot: dict[int, int] | None = None,
) -> DataFrame:
    """The enrolled-only extract: every attribute is required, repeated rows are kept.

    The joined rows are stored when this is called. ``ordered`` sorts by student and term; ``hot`` as for ``course_history``.
    """
    hot = hot_students(src) if hot is None else hot
    classes = src["class_dim"].select("class_nbr", "strm", "subject", "catalog_nbr")
    enrolled = _in_cohort(_enrolled(src["enrolment"], repeats=False), cohort, ["strm", "class_nbr"], hot)
    courses = attach_class(enrolled, classes, "inner")
    in_level = src["census"].where(F.col("um_clevel_descr").isin(*levels)).select("emplid", "strm", "um_clevel_descr")
    rows = src["progress"].where(F.col("acad_plan").isin(*plans)).join(in_level, ["emplid", "strm"])
    terms = _student_terms(rows, cohort, src["admissions"], "inner", hot)
    schedule = _with_lifetime_hours(courses.join(terms, ["emplid", "strm"]), SCHEDULE_COLUMNS, hot)
    return schedule.orderBy("emplid", "strm", *_TAIL) if ordered else schedule
