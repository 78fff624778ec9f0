import pytest

from coursepath.operators.status import (
    course_status,
    status_totals,
    student_base,
    taken_targets,
    to_wide,
)

from .data import by_student, frame, random_histories, row
from .walk import status_latest, status_sticky

LAST = "5427"
TARGETS = ["A_1000", "B_1000", "C_1000"]


def found(df):
    return {(r.emplid, r.target): r.status for r in df.collect()}


@pytest.mark.parametrize("mode,walk", [("latest", status_latest), ("sticky", status_sticky)])
def test_status_agrees_with_a_walk(spark, mode, walk):
    rows = random_histories(500, TARGETS + ["D_1000"], seed=5)
    got = found(course_status(frame(spark, rows), TARGETS, last_term=LAST, mode=mode, tiebreak=["seq"]))
    want = {
        (s, t): walk(mine, t)
        for s, mine in by_student(rows).items()
        if any(r["strm"] == LAST for r in mine)
        for t in TARGETS
    }
    assert got == want and set(want.values()) == {0, 1, 2}


@pytest.mark.parametrize(
    "points,grade,latest,sticky",
    [
        (3.0, "", 2, 2),
        (0.0, "F", 2, 1),
        (0.0, "f", 2, 1),
        (0.0, "", 1, 1),
        (None, "", 1, 0),
        (-1.0, "", 1, 0),
        (99.0, "", 2, 2),
    ],
)
def test_status_of_one_row(spark, points, grade, latest, sticky):
    df = frame(spark, [row("s", LAST, "A_1000", points, grade)])
    for mode, want in (("latest", latest), ("sticky", sticky)):
        assert found(course_status(df, ["A_1000"], last_term=LAST, mode=mode)) == {("s", "A_1000"): want}


def test_retake_in_progress_lowers_only_the_latest_mode(spark):
    df = frame(spark, [row("s", "5343", "A_1000", 2.0), row("s", LAST, "A_1000", 0.0)])
    assert found(course_status(df, ["A_1000"], last_term=LAST))["s", "A_1000"] == 1
    assert found(course_status(df, ["A_1000"], last_term=LAST, mode="sticky"))["s", "A_1000"] == 2


def test_given_base_decides_membership(spark):
    df = frame(spark, [row("s", "5343", "A_1000"), row("t", LAST, "A_1000")])
    base = spark.createDataFrame([("s",), ("new",)], "emplid string")
    assert found(course_status(df, ["A_1000"], base=base)) == {("s", "A_1000"): 2, ("new", "A_1000"): 0}


def test_base_is_the_first_row_by_tiebreak(spark):
    rows = [
        row("s", LAST, "A_1000", level="SENIOR", seq=2),
        row("s", LAST, "B_1000", level="JUNIOR", seq=1),
        row("s", "5343", "B_1000", level="FRESHMAN", seq=0),
        row("gone", "5343", "B_1000"),
    ]
    base = student_base(frame(spark, rows), LAST, ["emplid", "strm", "um_clevel_descr"], ["seq"])
    assert [tuple(r) for r in base.collect()] == [("s", LAST, "JUNIOR")]


def test_wide_totals_and_lists(spark):
    rows = [row("s", LAST, "A_1000", 3.0), row("s", LAST, "C_1000", 0.0), row("t", LAST, "D_1000")]
    matrix = course_status(frame(spark, rows), TARGETS, last_term=LAST)
    wide = {r.emplid: (r.A_1000, r.B_1000, r.C_1000) for r in to_wide(matrix, TARGETS).collect()}
    assert wide == {"s": (2, 0, 1), "t": (0, 0, 0)}
    assert tuple(status_totals(matrix).first()) == (1, 1)
    assert [tuple(r) for r in taken_targets(matrix).collect()] == [("s", ["A_1000", "C_1000"])]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        course_status(frame(spark, [row("s", LAST, "A_1000")]), TARGETS, last_term=LAST, mode="best")
