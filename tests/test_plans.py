"""What the physical plans must and must not contain."""

import functools
import re

import pytest
from pyspark.sql import functions as F

from checks.adapter import LAST_TERM, TIEBREAK, TIEBREAK_BITS, build_history, classed_history, sources
from checks.queries import QUERIES, RULES
from coursepath.operators import cohort, history
from coursepath.operators.keys import hot_keys
from coursepath.plans import batch
from coursepath.sources import SOURCE_SCHEMAS, load_sources
from coursepath.operators.eligibility import eligibility_state, eligible_terms, student_matrix, student_matrix_wide
from coursepath.operators.rules import Rule
from coursepath.operators.status import course_status


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df, name: str) -> list[str]:
    return re.findall(rf"^[\s:+*\-()\d]*{name}\b.*$", plan_of(df), re.M)


@pytest.fixture()
def no_broadcast(spark):
    """Room for a rule vocabulary of some tens of rows, whose size Spark knows, and for no other table."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "8k")
    yield
    spark.conf.set(key, before)


@functools.cache
def plan_of_query(spark, sf_dir, name) -> str:
    return plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_products(spark, sf_dir, name):
    plan = plan_of_query(spark, sf_dir, name)
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cohort_restriction_is_a_semi_join(spark, sf_dir):
    src = sources(spark, sf_dir)
    students = cohort.census_cohort(src["census"], LAST_TERM, by="program")
    assert "LeftSemi" in plan_of(history.course_history(src, students, "2400"))


@pytest.fixture()
def jobs(spark, monkeypatch):
    """The plans of the tables that operators store on the way, with whole paths."""
    plans = []
    real = history.stored_table
    key = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")

    def stored(df, name):
        plans.append(plan_of(df))
        return real(df, name)

    monkeypatch.setattr(history, "stored_table", stored)
    yield plans
    spark.conf.set(key, before)


FACTS = {"build_extract": ("enrolment", "transfer", "test_credit", "progress", "census", "admissions"), "build_schedule": ("enrolment", "progress", "census", "admissions")}


@pytest.mark.parametrize("name", FACTS)
def test_an_extract_evaluates_each_fact_once(spark, sf_dir, tmp_path, jobs, name):
    src = sources(spark, sf_dir)
    for table in SOURCE_SCHEMAS:
        src[table].write.parquet(str(tmp_path / table))
    stored = load_sources(spark, str(tmp_path))
    students = spark.createDataFrame([("00000001",)], "emplid string")
    rest = plan_of(getattr(history, name)(stored, students))
    (plan,) = jobs
    for fact in FACTS[name]:
        assert plan.count(f"{tmp_path}/{fact}]") == 1, fact
    assert str(tmp_path) not in rest
    # The cohort cuts each course fact first, without copies of it where no student is hot.
    assert plan.count("LeftSemi") >= (3 if name == "build_extract" else 1) and "Generate explode" not in plan


def test_only_hot_keys_are_copied(spark, sf_dir, no_broadcast):
    rows = classed_history(spark, sf_dir).select("emplid", "strm", "tot_cumulative")
    calm = history.with_lifetime_max(rows)
    assert "explode" not in plan_of(calm) and "_salt" not in plan_of(calm)
    skewed = rows.withColumn("emplid", F.when(F.col("tot_cumulative") % 2 == 0, "00000000").otherwise(F.col("emplid")))
    hot = hot_keys(skewed, "emplid", rows_per_copy=100)
    assert len(hot) == 1 and min(hot.values()) > 1
    salted, plain = history.with_lifetime_max(skewed, hot=hot), history.with_lifetime_max(skewed, hot={})
    assert "explode(sequence(0" in plan_of(salted) and salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_crosstabs_scan_the_history_once(spark, sf_dir, monkeypatch, tmp_path):
    plans = []
    real = batch.stored_table
    monkeypatch.setattr(batch, "stored_table", lambda df, name: (plans.append(df), real(df, name))[1])
    hist = classed_history(spark, sf_dir)
    monkeypatch.setattr(batch, "write_csv", lambda df, path: plans.append(df))
    batch.crosstab_batch(hist, LAST_TERM, str(tmp_path))
    assert plans[0].inputFiles() == hist.inputFiles() and len(operators(plans[0], "FileScan")) == 1
    assert len(plans) == 6 and not any(set(df.inputFiles()) & set(hist.inputFiles()) for df in plans[1:])


def test_counter_shuffles_rows_once_and_then_only_student_terms(spark, sf_dir, no_broadcast):
    df = eligible_terms(classed_history(spark, sf_dir), RULES, last_term=LAST_TERM)
    exchanges = operators(df, "Exchange hashpartitioning")
    assert [re.search(r"\(([^)]*)", e).group(1).count("#") for e in exchanges] == [1, 2]
    assert not operators(df, "SortAggregate") and not operators(df, "ObjectHashAggregate")
    assert len(operators(df, "Sort")) == 1


def test_status_aggregates_before_each_shuffle(spark, sf_dir, no_broadcast):
    df = course_status(classed_history(spark, sf_dir), ["STAT_2500"], last_term=LAST_TERM, tiebreak=TIEBREAK)
    assert len(operators(df, "Exchange hashpartitioning")) == 2
    assert not operators(df, "Window")
    assert plan_of(df).count("partial_max") >= 2


@pytest.mark.parametrize("make", [student_matrix, student_matrix_wide, eligibility_state])
def test_status_and_counters_come_from_one_scan(spark, sf_dir, no_broadcast, make):
    member = {} if make is eligibility_state else {"last_term": LAST_TERM}
    df = make(classed_history(spark, sf_dir), RULES, tiebreak=TIEBREAK_BITS, **member)
    assert len(operators(df, "FileScan")) == 1
    # Rows by student, term and write, then student terms by student; the rest stays in place.
    exchanges = operators(df, "Exchange hashpartitioning")
    assert [re.search(r"\(([^)]*)", e).group(1).count("#") for e in exchanges] == [1, 3]
    assert not operators(df, "SortMergeJoin") and not operators(df, "ObjectHashAggregate")
    if make is not eligibility_state:
        assert not operators(df, "SortAggregate")


@pytest.mark.parametrize("n", [10, 1000])
def test_any_number_of_rules_takes_one_scan(spark, sf_dir, n):
    rules = [Rule(f"T_{k}", min_hours=float(k % 90), clauses=((f"T_{k // 2}", "STAT_2500"),)) for k in range(n)]
    hist = classed_history(spark, sf_dir)
    assert len(operators(eligible_terms(hist, rules, last_term=LAST_TERM), "FileScan")) == 1
    assert len(operators(student_matrix(hist, rules, last_term=LAST_TERM, tiebreak=TIEBREAK_BITS), "FileScan")) == 1


def test_windows_run_over_student_terms_only(spark, sf_dir):
    for name in QUERIES:
        if name == "build_extract_ordered":
            continue  # its window only looks at the order of the result
        plan = plan_of_query(spark, sf_dir, name)
        for spec in re.findall(r"windowspecdefinition\(([^,]*), ([^ ]*)", plan):
            assert spec[0].startswith("emplid") and spec[1].startswith("strm"), (name, spec)
    windows = operators(build_history(spark, sf_dir), "Window")
    assert len(windows) == 1


def test_term_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["students_by_level"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = re.search(r"FileScan parquet \[([^\]]*)\].*PushedFilters: \[([^\]]*)", plan)
    assert scan.group(1).count("#") == 3
    assert "EqualTo(strm,2827)" in scan.group(2)
