"""One Spark query per operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursepath import fixed_values as fv
from coursepath import functions as fx
from coursepath.operators import cohort, eligibility, history, keys, reports, rollup, rules, status
from coursepath.plans import crosstabs
from coursepath.session import scratch_path, stored_table, tune
from coursepath.sources import SOURCE_SCHEMAS, export_eligible, load_sources, preview, read_history, read_rules, write_csv

from .adapter import FIRST_TERM, LAST_TERM, REFERENCE_TERM, TIEBREAK, TIEBREAK_BITS, classed_history, sources
from .adapter import history as long_history

RULES = rules.CURRENT_RULES + (rules.Rule("ENGLISH_1000", condreq=0),)
TARGETS = [r.target for r in RULES]
EXPORTED = [r for r in RULES if r.target in fv.EXPORT_TARGETS]
ARCHIVED = rules.ARCHIVED_RULES + (rules.Rule("ENGLISH_1000", condreq=0),)
BASE_COLUMNS = ["emplid", "strm", "um_clevel_descr", "acad_plan", "acad_subplan", "bus_maj", "tot_cumulative"]
LEVELS = fv.REPORT_LEVELS
COURSES = [
    "ACCTCY_2036", "ACCTCY_2037", "ACCTCY_2258", "MANGMT_3000", "MANGMT_3540", "MRKTNG_3000",
    "BUS_AD_3500", "MANGMT_3300", "MANGMT_4970", "FINANC_3000", "STAT_2500", "STAT_2200",
    "STAT_1200", "STAT_1300", "STAT_1400", "ECONOM_1014", "ABM_1041", "ECONOM_1015",
    "ECONOM_1051", "ABM_1042", "ACCTCY_2027", "ACCTCY_2137", "ACCTCY_2136", "ENGLISH_1000",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matrix(spark, sf_dir, listed=RULES) -> DataFrame:
    return eligibility.student_matrix(classed_history(spark, sf_dir), listed, last_term=LAST_TERM, tiebreak=TIEBREAK_BITS)


def _statuses(spark, sf_dir, mode="latest") -> DataFrame:
    return status.course_status(
        classed_history(spark, sf_dir), TARGETS, last_term=LAST_TERM, mode=mode, tiebreak=TIEBREAK
    )


def _base(spark, sf_dir) -> DataFrame:
    return status.student_base(long_history(spark, sf_dir), LAST_TERM, BASE_COLUMNS, TIEBREAK)


def _kept(spark, sf_dir) -> DataFrame:
    return long_history(spark, sf_dir).where(F.col("um_clevel_descr") != fv.DROPPED_LEVEL)


# Scans and sinks


@query
def history_table(spark, sf_dir):
    return long_history(spark, sf_dir)


@query
def history_csv_round_trip(spark, sf_dir):
    columns = ["emplid", "strm", "class_nbr", "acad_subplan", "grd_pts_per_unit", "tot_cumulative"]
    hist = long_history(spark, sf_dir).select(*columns, *TIEBREAK)
    path = scratch_path(spark, "history-csv")
    write_csv(fx.normalise_headers(hist, "upper"), path)
    back = read_history(spark, path, "csv", extra=TIEBREAK)
    return back.select(*columns, *[F.col(c).cast("long").alias(c) for c in TIEBREAK])


@query
def eligible_export_round_trip(spark, sf_dir):
    lists = reports.eligible_not_enrolled(_matrix(spark, sf_dir, EXPORTED), _base(spark, sf_dir))
    path = scratch_path(spark, "eligible")
    export_eligible(lists, fv.EXPORT_TARGETS, path, fmt="parquet")
    return spark.read.parquet(path).select("target", "emplid", "status", "sem_eli")


@query
def rule_table_statuses(spark, sf_dir):
    """Status of the targets of a rule table that went through a file."""
    path = scratch_path(spark, "rules")
    write_csv(rules.rules_table(spark, RULES), path)
    read_back = rules.rules_from_table(read_rules(spark, path, "csv"), conditions=())
    matrix = eligibility.eligible_terms(classed_history(spark, sf_dir), read_back, last_term=LAST_TERM)
    return matrix.groupBy("target").agg(F.sum("sem_eli").alias("terms"), F.count("sem_eli").alias("students"))


@query
def rule_table_first_rows(spark, sf_dir):
    """A rule table with repeated and blank targets, one row per class and line number: the least ``ord`` counts."""
    lines = classed_history(spark, sf_dir).select("class", "l_linenumber").distinct()
    table = lines.select(
        F.col("l_linenumber").cast("int").alias("ord"),
        F.when(F.col("l_linenumber") > 1, F.lower("class")).alias("class"),
        (F.col("l_linenumber") % 2).cast("int").alias("condreq"),
        (F.col("l_linenumber") * 10.0).alias("min_hours"),
    )
    path = scratch_path(spark, "rules")
    write_csv(table.unionByName(table), path)
    found = rules.rules_from_table(read_rules(spark, path, "csv"))
    return spark.createDataFrame([(r.target, r.condreq, r.min_hours) for r in found], "target string, condreq int, min_hours double")


@query
def history_csv_files(spark, sf_dir):
    """Two CSV files with their columns in another order, read as one."""
    columns = ["emplid", "strm", "acad_plan", "acad_subplan"]
    hist = long_history(spark, sf_dir).select(*columns, "l_orderkey")
    path = scratch_path(spark, "history-files")
    write_csv(hist.where("l_orderkey % 2 = 0").select(*columns), path)
    write_csv(hist.where("l_orderkey % 2 = 1").select(*reversed(columns)), path, mode="append")
    return read_history(spark, path, "csv").groupBy(*columns).agg(F.count("*").alias("n"))


@query
def history_csv_quarantine(spark, sf_dir):
    """A CSV with some rows of one field too many, which go to a table of their own."""
    torn = F.when(F.col("l_orderkey") % 50 == 7, F.concat("acad_plan", F.lit(",torn"))).otherwise(F.col("acad_plan"))
    hist = long_history(spark, sf_dir).select("emplid", "strm", torn.alias("acad_plan"))
    path, bad = scratch_path(spark, "history-torn"), scratch_path(spark, "history-bad")
    hist.write.option("header", True).option("quote", "\u0000").csv(path)
    kept = read_history(spark, path, "csv", multi_line=False, quarantine=bad).groupBy("strm").agg(F.count("*").alias("kept"))
    torn = spark.read.parquet(bad).groupBy(F.split("record", ",")[1].alias("strm")).agg(F.count("*").alias("bad"))
    return kept.join(torn, "strm", "full_outer").na.fill(0)


@query
def load_sources_round_trip(spark, sf_dir):
    """The seven tables written and read back; the enrolment facts have some text for a number."""
    src, path = sources(spark, sf_dir), scratch_path(spark, "sources")
    for name in SOURCE_SCHEMAS:
        src[name].write.parquet(f"{path}/{name}")
    columns = ["emplid", "strm", "class_nbr", "grading_basis_enrl", "grd_pts_per_unit", "acad_prog"]
    return load_sources(spark, path)["enrolment"].groupBy(*columns).agg(F.count("*").alias("n"))


@query
def preview_rows(spark, sf_dir):
    """Any rows may come back, so what is compared is how many there are and that all meet the condition."""
    rows = preview(sources(spark, sf_dir)["enrolment"], 20, F.col("strm") == REFERENCE_TERM)
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("strm") == REFERENCE_TERM).alias("all_meet"))


# Cohorts, membership, admissions


@query
def census_cohort_group(spark, sf_dir):
    return cohort.census_cohort(sources(spark, sf_dir)["census"], REFERENCE_TERM)


@query
def census_cohort_levels(spark, sf_dir):
    return cohort.census_cohort(sources(spark, sf_dir)["census"], REFERENCE_TERM, levels=fv.UNDERGRAD_LEVELS)


@query
def census_cohort_program(spark, sf_dir):
    return cohort.census_cohort(sources(spark, sf_dir)["census"], REFERENCE_TERM, by="program")


@query
def census_listing_top(spark, sf_dir):
    tiebreak = ["emplid", "um_clevel_descr", "um_acad_plan1", "um_acad_sub_plan1"]
    return cohort.census_listing(sources(spark, sf_dir)["census"], REFERENCE_TERM, tiebreak=tiebreak)


@query
def admissions_list(spark, sf_dir):
    columns = ["admit_term_rollup", "admit_term_rollup_descrshort", "emplid", "admit_type", "um_deg_seeking"]
    return cohort.admissions_list(sources(spark, sf_dir)["admissions"], columns=columns)


@query
def earliest_admit(spark, sf_dir):
    return cohort.earliest_admit(sources(spark, sf_dir)["admissions"])


@query
def restrict_semi(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return keys.restrict_to(customers, urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query
def exclude_anti(spark, sf_dir):
    urgent = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return keys.exclude(customers, urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query
def left_attach(spark, sf_dir):
    builders = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(builders.select("c_custkey", "c_mktsegment"), "c_custkey", "left")


@query
def students_in_both(spark, sf_dir):
    hist = long_history(spark, sf_dir)
    return keys.common_keys(hist.where("acad_subplan = 'FIN_BANK'"), hist.where("acad_subplan = 'REAL_EST'"))


@query
def students_in_first_only(spark, sf_dir):
    hist = long_history(spark, sf_dir)
    return keys.keys_only_in(hist.where("acad_subplan = 'FIN_BANK'"), hist.where("acad_subplan = 'REAL_EST'"))


# Extracts


@query
def attach_class(spark, sf_dir):
    src = sources(spark, sf_dir)
    classes = src["class_dim"].where("acad_group = 'CBUSN'").select("class_nbr", "strm", "subject", "catalog_nbr")
    rows = src["enrolment"].select("emplid", "strm", "class_nbr", "grading_basis_enrl")
    return history.attach_class(rows, classes)


@query
def class_fan_out(spark, sf_dir):
    """Class numbers that recur across terms, so that a join without the term would multiply rows."""
    return keys.repeated_keys(sources(spark, sf_dir)["class_dim"], ["class_nbr"])


@query
def class_join_rows(spark, sf_dir):
    """Rows into and out of the join with the classes, by both keys and by the number alone, as guards count them."""
    src, found = sources(spark, sf_dir), []
    rows, classes = src["enrolment"].select("emplid", "class_nbr", "strm"), src["class_dim"].select("class_nbr", "strm", "subject")
    both, alone = keys.JoinGuard("class_and_term"), keys.JoinGuard("class_alone")
    joins = {
        "class and term": (both, history.attach_class(rows, classes, guard=both)),
        "class alone": (alone, alone.join(rows, classes.drop("strm"), "class_nbr", "left")),
    }
    for how, (guard, joined) in joins.items():
        joined.write.format("noop").mode("overwrite").save()
        found.append((how, guard.rows_in, guard.rows_out))
    return spark.createDataFrame(found, "how string, rows_in long, rows_out long")


@query
def course_catalog(spark, sf_dir):
    return history.course_catalog(sources(spark, sf_dir)["class_dim"])


@query
def course_description(spark, sf_dir):
    return rollup.latest_description(sources(spark, sf_dir)["class_dim"])


@query
def lifetime_max(spark, sf_dir):
    rows = long_history(spark, sf_dir).select("emplid", "strm", "class_nbr", "tot_cumulative", *TIEBREAK)
    return history.with_lifetime_max(rows)


@query
def course_history_union_all(spark, sf_dir):
    src = sources(spark, sf_dir)
    students = cohort.census_cohort(src["census"], REFERENCE_TERM, by="program")
    return history.course_history(src, students, FIRST_TERM)


@query
def course_history_union(spark, sf_dir):
    return history.course_history_by_subject(sources(spark, sf_dir), terms=F.col("strm") >= FIRST_TERM)


@query
def course_history_union_terms(spark, sf_dir):
    terms = F.col("strm").isin(REFERENCE_TERM, LAST_TERM)
    return history.course_history_by_subject(sources(spark, sf_dir), terms=terms)


@query
def build_extract(spark, sf_dir):
    src = sources(spark, sf_dir)
    students = cohort.census_cohort(src["census"], REFERENCE_TERM, by="program")
    return history.build_extract(src, students, first_term=FIRST_TERM)


@query
def build_extract_ordered(spark, sf_dir):
    """The place of each term among those of its student, as the ordered extract has them."""
    src = sources(spark, sf_dir)
    students = cohort.census_cohort(src["census"], REFERENCE_TERM, by="program")
    rows = history.build_extract(src, students, first_term=FIRST_TERM, ordered=True)
    placed = rows.select("emplid", "strm", F.monotonically_increasing_id().alias("at"))
    terms = placed.groupBy("emplid", "strm").agg(F.min("at").alias("at"))
    order = Window.partitionBy("emplid").orderBy("at")
    return terms.select("emplid", "strm", F.row_number().over(order).cast("long").alias("place"))


@query
def build_schedule(spark, sf_dir):
    src = sources(spark, sf_dir)
    students = cohort.census_cohort(src["census"], REFERENCE_TERM)
    return history.build_schedule(src, students).drop("last_upd_dt_stmp")


@query
def class_rollup(spark, sf_dir):
    src = sources(spark, sf_dir)
    return rollup.class_rollup(src["enrolment"], src["class_dim"], REFERENCE_TERM)


@query
def student_classes(spark, sf_dir):
    """Every student's classes of one term; the operator also takes a single id."""
    src = sources(spark, sf_dir)
    columns = ["emplid", "strm", "class_nbr", "crse_grade_input", "grd_pts_per_unit", "term", "subject", "catalog_nbr", "class_section"]
    return rollup.student_classes(src["enrolment"], src["class_dim"], REFERENCE_TERM).select(*columns).distinct()


# Columns


@query
def class_key(spark, sf_dir):
    parts = long_history(spark, sf_dir).select(*TIEBREAK, "subject", "catalog_nbr")
    # Also a long number and one without digits.
    odd = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("9"), "catalog_nbr")).when(
        F.col("l_linenumber") == 2, "W"
    )
    return parts.select(
        *TIEBREAK,
        fx.class_key(F.col("subject"), F.col("catalog_nbr")).alias("class"),
        fx.class_key(F.col("subject"), odd, "XXXX").alias("odd_class"),
    )


@query
def strip_suffix(spark, sf_dir):
    name = F.concat("class", F.lit("_"), F.col("l_linenumber").cast("string"))
    hist = classed_history(spark, sf_dir).select(name.alias("column_name")).distinct()
    return hist.select(
        "column_name",
        fx.strip_suffix(F.col("column_name")).alias("class"),
        fx.suffix_of(F.col("column_name")).alias("suffix"),
    )


@query
def coerce_points(spark, sf_dir):
    number = F.col("l_linenumber").cast("string")
    text = (
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(number, F.lit(".25")))
        .when(F.col("l_suppkey") % 4 == 1, "")
        .when(F.col("l_suppkey") % 4 == 2, F.concat(number, F.lit(" pts")))
    )
    rows = _table(spark, sf_dir, "lineitem").select(*TIEBREAK, text.alias("points_text"))
    return rows.select(*TIEBREAK, fx.coerce_number(F.col("points_text")).alias("points"))


@query
def level_labels(spark, sf_dir):
    src = sources(spark, sf_dir)
    census = src["census"].where("um_deg_seeking = 'Y'").select("emplid", "strm", "um_clevel_descr")
    rows = src["progress"].select("emplid", "strm", "acad_subplan").join(census, ["emplid", "strm"], "left")
    return rows.select("emplid", "strm", "acad_subplan", fx.level_or_label(F.col("um_clevel_descr")).alias("student_level"))


@query
def plan_flags(spark, sf_dir):
    progress = sources(spark, sf_dir)["progress"].select("emplid", "strm", "acad_plan", "acad_subplan")
    return fx.with_plan_flag(progress)


# Status and eligibility


@query
def student_base(spark, sf_dir):
    return _base(spark, sf_dir)


@query
def course_status_latest(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query
def course_status_sticky(spark, sf_dir):
    return _statuses(spark, sf_dir, "sticky")


@query
def status_totals(spark, sf_dir):
    return status.status_totals(_statuses(spark, sf_dir))


@query
def taken_targets(spark, sf_dir):
    taken = status.taken_targets(_statuses(spark, sf_dir))
    return taken.select("emplid", F.array_join("targets", ",").alias("targets"))


@query
def value_counts(spark, sf_dir):
    statuses = _statuses(spark, sf_dir).where("target = 'ACCTCY_2036'")
    return keys.value_counts(statuses, "status")


@query
def term_summary(spark, sf_dir):
    summary = eligibility.term_summary(classed_history(spark, sf_dir), COURSES)
    return summary.select(
        "emplid",
        "strm",
        "max_hours",
        "flag",
        F.array_join("levels", ",").alias("levels"),
        F.size("classes_taken").alias("n_taken"),
        F.size("classes_passed").alias("n_passed"),
    )


@query
def term_index(spark, sf_dir):
    return eligibility.with_term_index(long_history(spark, sf_dir))


@query
def eligible_terms(spark, sf_dir):
    return eligibility.eligible_terms(classed_history(spark, sf_dir), RULES, last_term=LAST_TERM)


@query
def eligible_terms_archived(spark, sf_dir):
    return eligibility.eligible_terms(
        classed_history(spark, sf_dir), ARCHIVED, last_term=LAST_TERM, skip_suffix=None
    )


@query
def eligible_terms_v1(spark, sf_dir):
    return eligibility.eligible_terms_v1(classed_history(spark, sf_dir), last_term=LAST_TERM)


@query
def student_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query
def student_matrix_v1(spark, sf_dir):
    return eligibility.student_matrix_v1(classed_history(spark, sf_dir), last_term=LAST_TERM)


@query
def student_wide(spark, sf_dir):
    wide = eligibility.student_matrix_wide(classed_history(spark, sf_dir), RULES, last_term=LAST_TERM, tiebreak=TIEBREAK_BITS)
    return _base(spark, sf_dir).join(wide, "emplid", "left")


@query
def student_matrix_by_terms(spark, sf_dir):
    """The state of all terms before the last, stored, and the last term's rows alone added to it."""
    hist, options = classed_history(spark, sf_dir), {"rules": RULES, "tiebreak": TIEBREAK_BITS}
    path = scratch_path(spark, "eligibility-state")
    eligibility.eligibility_state(hist.where(F.col("strm") < LAST_TERM), **options).write.parquet(path)
    state = eligibility.advance_state(spark.read.parquet(path), hist.where(F.col("strm") == LAST_TERM), LAST_TERM, **options)
    return eligibility.matrix_of_state(state, LAST_TERM, RULES)


@query
def eligibility_stats(spark, sf_dir):
    return reports.eligibility_stats(_matrix(spark, sf_dir), TARGETS, digits=None)


@query
def eligibility_stats_rounded(spark, sf_dir):
    return reports.eligibility_stats(_matrix(spark, sf_dir), TARGETS, enrolled=f"enrolled_{LAST_TERM}")


@query
def eligible_not_enrolled(spark, sf_dir):
    return reports.eligible_not_enrolled(_matrix(spark, sf_dir, EXPORTED), _base(spark, sf_dir))


# Reports


@query
def student_count(spark, sf_dir):
    return keys.count_students(long_history(spark, sf_dir))


@query
def students_by_level(spark, sf_dir):
    return reports.students_by_level(long_history(spark, sf_dir), term=REFERENCE_TERM)


@query
def students_by_level_sorted(spark, sf_dir):
    return reports.students_by_level_sorted(_kept(spark, sf_dir))


@query
def plan_level_crosstab(spark, sf_dir):
    return reports.plan_level_table(long_history(spark, sf_dir))


@query
def all_plans_level_crosstab(spark, sf_dir):
    return reports.plan_level_table(long_history(spark, sf_dir), plans=None)


@query
def subplan_level_crosstab(spark, sf_dir):
    return reports.subplan_level_table(long_history(spark, sf_dir))


@query
def named_subplan_level_crosstab(spark, sf_dir):
    return reports.subplan_level_table(long_history(spark, sf_dir), drop_blank=True)


@query
def overlap_totals(spark, sf_dir):
    return reports.overlap_report(_kept(spark, sf_dir), "FIN_BANK", "REAL_EST")


@query
def overlap_exclusive(spark, sf_dir):
    return reports.overlap_report(_kept(spark, sf_dir), "FIN_BANK", "REAL_EST", exclusive=True)


@query
def level_counts_of_subplan(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return reports.level_counts_of(kept, kept.where("acad_subplan = 'FIN_BANK'").select("emplid"))


@query
def crosstabs_of_cells(spark, sf_dir):
    """All five cross-tabs, one under the other, from one scan of the history."""
    cells = stored_table(reports.student_cells(long_history(spark, sf_dir), REFERENCE_TERM), "cells")
    tables = []
    for name, table in crosstabs(cells, REFERENCE_TERM).items():
        label, *measures = table.columns
        rows = table.withColumnRenamed(label, "label").unpivot("label", measures, "measure", "n")
        tables.append(rows.select(F.lit(name).alias("report"), "label", "measure", "n"))
    return reduce(DataFrame.unionByName, tables)
