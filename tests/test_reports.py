import math
import statistics

import pytest

from coursepath import fixed_values as fv
from coursepath.operators.keys import count_students, value_counts
from coursepath.operators.reports import (
    crosstab_students,
    eligibility_stats,
    eligible_not_enrolled,
    level_counts_of,
    order_with_tail,
    overlap_report,
    plan_level_table,
    students_by_level,
    students_by_level_sorted,
    subplan_level_table,
)

ROWS = [
    # emplid, strm, level, plan, subplan
    ("1", "5343", "FRESHMAN", "ACCT_BSACC", "FIN_BANK"),
    ("1", "5343", "FRESHMAN", "ACCT_BSACC", "FIN_BANK"),
    ("1", "5427", "SOPHOMORE", "ACCT_BSACC", "REAL_EST"),
    ("2", "5343", "SENIOR", "UNDEC_BUS", "REAL_EST"),
    ("3", "5343", "", "OTHER", "FIN_BANK"),
    ("4", "5343", "2ND BACH", "ACCT_BSACC", "FIN_BANK"),
    ("5", "5343", "MASTERS", "BUSAD_BSBA", ""),
    ("6", "5427", "SENIOR", "BUSAD_BSBA", "ZOO"),
    ("7", "5343", "", "GHOST", "AAA"),
]


@pytest.fixture(scope="module")
def hist(spark):
    return spark.createDataFrame(
        ROWS, "emplid string, strm string, um_clevel_descr string, acad_plan string, acad_subplan string"
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_statistics_per_target(spark):
    cells = [("A", 0, 1), ("A", 0, 2), ("A", 0, 5), ("A", 0, 0), ("A", 1, 3), ("A", 2, 4), ("B", 0, 3), ("C", 1, 0)]
    matrix = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cells)], "emplid string, target string, status int, sem_eli int")
    got = {r.target: tuple(r)[1:] for r in eligibility_stats(matrix, ["A", "B", "C", "D"], digits=None).collect()}
    mean, sd, waiting, enrolled = got["A"]
    assert math.isclose(mean, 8 / 3) and math.isclose(sd, statistics.stdev([1, 2, 5])) and (waiting, enrolled) == (3, 1)
    assert got["B"] == (3.0, 0.0, 1, 0) and got["C"] == (0.0, 0.0, 0, 1) and got["D"] == (0.0, 0.0, 0, 0)
    rounded = eligibility_stats(matrix, ["D", "A"], enrolled="enrolled_5427")
    assert rows(rounded) == [("D", 0.0, 0.0, 0, 0), ("A", 2.67, 2.08, 3, 1)]
    assert rounded.columns[-1] == "enrolled_5427"


def test_rounding_is_half_even(spark):
    cells = [("A", 0, n) for n in [1, 1, 1, 1, 1, 1, 1, 2]]
    matrix = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cells)], "emplid string, target string, status int, sem_eli int")
    assert eligibility_stats(matrix, ["A"]).first().mean_terms == 1.12


def test_eligible_lists(spark):
    matrix = spark.createDataFrame(
        [("1", "FINANC_3000", 0, 2), ("2", "FINANC_3000", 1, 2), ("1", "MRKTNG_3000", 0, 0), ("1", "STAT_2500", 0, 1)],
        "emplid string, target string, status int, sem_eli int",
    )
    base = spark.createDataFrame([("1", "BUSNU"), ("2", "BUSNU")], "emplid string, acad_prog string")
    assert rows(eligible_not_enrolled(matrix, base)) == [("1", "BUSNU", "FINANC_3000", 0, 2)]


def test_students_by_level_has_every_level_in_order(hist):
    assert rows(students_by_level(hist, term="5343")) == [
        ("FRESHMAN", 1), ("SOPHOMORE", 0), ("JUNIOR", 0), ("SENIOR", 1),
    ]
    most_first = rows(students_by_level_sorted(hist))
    assert most_first == [("SENIOR", 2), ("FRESHMAN", 1), ("SOPHOMORE", 1), ("MASTERS", 1), ("JUNIOR", 0)]
    assert count_students(hist).first()[0] == 7
    assert dict(rows(value_counts(hist, "strm"))) == {"5343": 7, "5427": 2}


def test_plan_table_counts_a_student_once_per_level(hist):
    table = plan_level_table(hist)
    assert table.columns == ["acad_plan", "freshman", "sophomore", "junior", "senior", "masters", "total"]
    assert sorted(rows(table)) == [
        ("ACCT_BSACC", 1, 1, 0, 0, 0, 2), ("BUSAD_BSBA", 0, 0, 0, 1, 1, 2), ("UNDEC_BUS", 0, 0, 0, 1, 0, 1),
    ]
    assert ("GHOST", 0, 0, 0, 0, 0, 0) in rows(plan_level_table(hist, plans=None))
    assert rows(crosstab_students(hist, "strm", ["SENIOR"], names=["n"]).orderBy("strm")) == [("5343", 1), ("5427", 1)]


def test_subplan_table_ends_with_the_named_subplans(hist):
    assert [r[0] for r in rows(subplan_level_table(hist))] == ["", "ZOO", "FIN_BANK", "REAL_EST"]
    assert [r[0] for r in rows(subplan_level_table(hist, drop_blank=True))] == ["ZOO", "FIN_BANK", "REAL_EST"]
    assert [r[0] for r in rows(order_with_tail(hist.select("acad_subplan").distinct(), "acad_subplan", ["AAA"]))][-1] == "AAA"


def test_overlap(hist):
    kept = hist.where(hist.um_clevel_descr != fv.DROPPED_LEVEL)
    totals = {r.level: (r.a_total, r.b_total, r.both) for r in overlap_report(kept, "FIN_BANK", "REAL_EST").collect()}
    assert totals == {
        "FRESHMAN": (1, 1, 1), "SOPHOMORE": (1, 1, 1), "JUNIOR": (0, 0, 0), "SENIOR": (0, 1, 0),
        "MASTERS": (0, 0, 0), "TOTAL_UNIQUE": (2, 2, 1),
    }
    split = overlap_report(kept, "FIN_BANK", "REAL_EST", exclusive=True).collect()
    assert {r.level: (r.a_only, r.b_only, r.both, r.total_unique) for r in split} == {
        "FRESHMAN": (0, 0, 1, 1), "SOPHOMORE": (0, 0, 1, 1), "JUNIOR": (0, 0, 0, 0), "SENIOR": (0, 1, 0, 1),
        "MASTERS": (0, 0, 0, 0),
    }
    only = kept.where("acad_subplan = 'FIN_BANK'").select("emplid")
    assert dict(rows(level_counts_of(kept, only)))["SOPHOMORE"] == 1
