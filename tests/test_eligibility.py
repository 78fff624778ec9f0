import pytest

from coursepath.operators.eligibility import (
    advance_state,
    eligibility_state,
    eligible_terms,
    eligible_terms_v1,
    matrix_of_state,
    student_matrix,
    student_matrix_v1,
    student_matrix_wide,
    term_summary,
)
from coursepath.operators.rules import ARCHIVED_RULES, CURRENT_RULES, Rule, V1_RULES

from .data import by_student, frame, random_histories, row
from .walk import count_current, count_v1, status_latest, status_sticky

OPEN = Rule("ENGLISH_1000", condreq=0)
RULES = CURRENT_RULES + (OPEN, Rule("NOPE_1000"))
COURSES = [
    "ACCTCY_2036", "ACCTCY_2037", "ACCTCY_2136", "ACCTCY_2258", "MANGMT_3000", "MRKTNG_3000", "FINANC_3000",
    "BUS_AD_3500", "MANGMT_4970", "STAT_2500", "STAT_2200", "STAT_1300", "ECONOM_1014", "ECONOM_1015", "ABM_1041",
    "ACCTCY_2027", "ENGLISH_1000", "OTHER_1000", "NOPE_1000",
]
LAST = "5427"


def counts(df):
    return {(r.emplid, r.target): r.sem_eli for r in df.collect()}


def one(spark, rows, rule, last, **options):
    found = counts(eligible_terms(frame(spark, rows), [rule], last_term=last, **options))
    return found[("s", rule.target)]


def term_rows(hours_by_term, **fixed):
    return [row("s", strm, "OTHER_1000", hours=h, **fixed) for strm, h in hours_by_term]


@pytest.mark.parametrize("skip", ["35", None])
def test_counter_agrees_with_a_walk_over_terms(spark, skip):
    rows = random_histories(1500, COURSES, seed=11)
    rules = RULES if skip else ARCHIVED_RULES + (OPEN,)
    got = counts(eligible_terms(frame(spark, rows), rules, last_term=LAST, skip_suffix=skip))
    want = {
        (s, r.target): count_current(r, mine, skip)
        for s, mine in by_student(rows).items()
        if any(x["strm"] == LAST for x in mine)
        for r in rules
    }
    assert got == want
    assert len(set(want.values())) > 5


@pytest.mark.parametrize("last", [LAST, "5135", "9999"])
def test_v1_counter_agrees_with_a_walk_over_terms(spark, last):
    rows = random_histories(800, COURSES, seed=12)
    df = frame(spark, rows)
    base = df.select("emplid").distinct()
    got = counts(eligible_terms_v1(df, V1_RULES, last_term=last, base=base))
    want = {
        (s, r.target): count_v1(r, mine, last) for s, mine in by_student(rows).items() for r in V1_RULES
    }
    assert got == want
    assert len(set(want.values())) > 5


def test_more_targets_than_bits_in_one_word(spark):
    names = [f"COURSE_{i:04d}" for i in range(150)]
    rules = [Rule(names[0], condreq=0)] + [
        Rule(name, min_hours=float(i % 40), clauses=((names[i - 1], names[(i * 7) % 150]),))
        for i, name in enumerate(names[1:], start=1)
    ]
    rows = random_histories(60, names, seed=13)
    got = counts(eligible_terms(frame(spark, rows), rules, last_term=LAST))
    want = {
        (s, r.target): count_current(r, mine)
        for s, mine in by_student(rows).items()
        if any(x["strm"] == LAST for x in mine)
        for r in rules
    }
    assert got == want and any(want.values())


def test_matrix_has_status_and_counter_of_the_same_students(spark):
    rows = random_histories(300, COURSES, seed=14)
    got = student_matrix(frame(spark, rows), RULES, last_term=LAST, tiebreak=["seq"]).collect()
    students = {s: m for s, m in by_student(rows).items() if any(x["strm"] == LAST for x in m)}
    assert len(got) == len(students) * len(RULES)
    rules = {r.target: r for r in RULES}
    for r in got:
        mine = students[r.emplid]
        assert (r.status, r.sem_eli) == (status_latest(mine, r.target), count_current(rules[r.target], mine))


def test_v1_matrix(spark):
    rows = random_histories(200, COURSES, seed=15)
    got = student_matrix_v1(frame(spark, rows), last_term=LAST).collect()
    students = {s: m for s, m in by_student(rows).items() if any(x["strm"] == LAST for x in m)}
    rules = {r.target: r for r in V1_RULES}
    assert len(got) == len(students) * len(rules)
    for r in got:
        mine = students[r.emplid]
        assert (r.status, r.sem_eli) == (status_sticky(mine, r.target), count_v1(rules[r.target], mine, LAST))


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [row("s", "5227", "A_1000", nan, hours=nan), row("s", "5243", "B_1000", hours=10)]
    rules = [Rule("T_1000", min_hours=45), Rule("U_1000", clauses=(("A_1000",),)), Rule("A_1000", condreq=0)]
    got = {r.target: (r.status, r.sem_eli) for r in student_matrix(frame(spark, rows), rules, last_term="5243").collect()}
    assert got == {"T_1000": (0, 0), "U_1000": (0, 0), "A_1000": (1, 0)}


def test_base_keeps_students_without_history(spark):
    df = frame(spark, term_rows([("5227", 30), ("5243", 40)]))
    base = spark.createDataFrame([("s",), ("absent",)], "emplid string")
    found = counts(eligible_terms(df, [OPEN], base=base))
    assert found == {("s", "ENGLISH_1000"): 1, ("absent", "ENGLISH_1000"): 0}


def test_membership_needs_exactly_one_source(spark):
    df = frame(spark, term_rows([("5227", 30)]))
    with pytest.raises(ValueError):
        eligible_terms(df, [OPEN])


def test_unconditional_target_skips_summer_gap(spark):
    rows = term_rows([("5227", 0), ("5235", 0), ("5243", 0), ("5327", 0)])
    assert one(spark, rows, OPEN, "5327") == 2
    assert one(spark, rows, OPEN, "5327", skip_suffix=None) == 3


def test_target_taken_in_first_term_counts_nothing(spark):
    rows = [row("s", "5227", "ENGLISH_1000")] + term_rows([("5243", 0)])
    assert one(spark, rows, OPEN, "5243") == 0


def test_summer_taking_term_counts(spark):
    rows = term_rows([("5143", 0), ("5227", 0)]) + [row("s", "5235", "ENGLISH_1000")]
    assert one(spark, rows, OPEN, "5235") == 2


@pytest.mark.parametrize("hours,expected", [(28, 2), (27, 1), (27.5, 1)])
def test_hours_count_from_the_term_after_they_are_reached(spark, hours, expected):
    rows = term_rows([("5227", hours), ("5243", 28), ("5327", 30)])
    assert one(spark, rows, Rule("ACCTCY_2036", min_hours=28), "5327") == expected


def test_passing_the_prerequisite_in_the_taking_term_is_too_late(spark):
    rule = Rule("ACCTCY_2037", clauses=(("ACCTCY_2036", "ACCTCY_2136"),))
    rows = term_rows([("5227", 0)]) + [row("s", "5243", "ACCTCY_2036"), row("s", "5243", "ACCTCY_2037")]
    assert one(spark, rows, rule, "5243") == 0


def test_conditions_must_hold_in_one_term(spark):
    rule = Rule("T_1000", min_hours=45, clauses=(("A_1000",),))
    early = term_rows([("5127", 45)]) + [row("s", "5143", "A_1000", hours=44)]
    assert one(spark, early + term_rows([("5227", 44)]), rule, "5227") == 0
    assert one(spark, early + term_rows([("5227", 45), ("5243", 45)]), rule, "5243") == 1


def test_a_condition_once_met_stays_met(spark):
    rule = Rule("T_1000", min_hours=45)
    assert one(spark, term_rows([("5127", 45), ("5143", 10), ("5227", 10)]), rule, "5227") == 2


def test_rule_without_condition_is_never_met(spark):
    assert one(spark, term_rows([("5127", 200), ("5143", 200)]), Rule("T_1000"), "5143") == 0


def test_student_absent_in_last_term_is_left_out(spark):
    df = frame(spark, term_rows([("5127", 45), ("5143", 10)]))
    assert counts(eligible_terms(df, [OPEN], last_term="5227")) == {}


def test_term_summary(spark):
    rows = [
        row("s", "5127", "A_1000", 0.0, hours=3.0, level="senior", flag=0),
        row("s", "5127", "B_1000", 3.0, hours=6.0, level="SENIOR", flag=1),
        row("s", "5127", "C_1000", 3.0, hours=None, level="SENIOR"),
    ]
    (found,) = term_summary(frame(spark, rows), ["A_1000", "B_1000"]).collect()
    assert (found.max_hours, found.flag, found.levels) == (6.0, 1, ["SENIOR"])
    assert (found.classes_taken, found.classes_passed) == (["A_1000", "B_1000"], ["B_1000"])


def test_names_with_quotes(spark):
    odd = "O'BRIENS\\_1000"
    rule = Rule(odd, levels=("IT'S",))
    rows = [row("s", "5227", "A_1000", level="it's"), row("s", "5243", odd)]
    got = student_matrix(frame(spark, rows), [rule], last_term="5243").collect()
    assert [tuple(r) for r in got] == [("s", odd, 2, 1)]


def cells(df):
    return {(r.emplid, r.target): (r.status, r.sem_eli) for r in df.collect()}


def many_rules(n):
    names = [f"COURSE_{i:04d}" for i in range(n)]
    rest = [Rule(t, min_hours=float(i % 40), clauses=((names[i - 1], names[i * 7 % n]),)) for i, t in enumerate(names[1:], start=1)]
    return names, [Rule(names[0], condreq=0)] + rest


def test_a_thousand_rules_in_one_matrix(spark):
    names, rules = many_rules(1000)
    rows = random_histories(40, names[:60] + names[-60:], seed=16)
    got = cells(student_matrix(frame(spark, rows), rules, last_term=LAST, tiebreak=["seq"]))
    want = {
        (s, r.target): (status_latest(mine, r.target), count_current(r, mine))
        for s, mine in by_student(rows).items()
        if any(x["strm"] == LAST for x in mine)
        for r in rules
    }
    assert got == want and len(set(want.values())) > 8


@pytest.mark.parametrize("tiebreak", [["seq"], {"seq": 5}, ["seq", "crse_grade_input"], {"seq": 60, "bus_maj": 60}])
def test_matrix_for_every_kind_of_tiebreak(spark, tiebreak):
    """An int, a stated width, a text that cannot be packed, and two longs that make a decimal."""
    rows = random_histories(150, COURSES, seed=17)
    got = cells(student_matrix(frame(spark, rows), RULES, last_term=LAST, tiebreak=tiebreak))
    assert got == cells(student_matrix(frame(spark, rows), RULES, last_term=LAST, tiebreak=["seq"]))


def test_a_value_outside_the_stated_width_is_an_error(spark):
    df = frame(spark, [row("s", LAST, RULES[0].target, seq=9)])
    with pytest.raises(Exception, match="more than the stated 3 bits"):
        student_matrix(df, RULES, last_term=LAST, tiebreak={"seq": 3}).collect()


def test_wide_matrix_has_the_cells_of_the_long_one(spark):
    df = frame(spark, random_histories(100, COURSES, seed=18))
    wide = student_matrix_wide(df, RULES, last_term=LAST, tiebreak=["seq"], names={"NOPE_1000": "NOPE_1000_X"}).collect()
    want = cells(student_matrix(df, RULES, last_term=LAST, tiebreak=["seq"]))
    name = lambda t: "NOPE_1000_X" if t == "NOPE_1000" else t
    assert {(r.emplid, x.target): (r[name(x.target)], r[name(x.target) + "_SEM_ELI"]) for r in wide for x in RULES} == want


@pytest.mark.parametrize("mode", ["latest", "sticky"])
def test_terms_added_one_by_one_equal_a_full_run_after_each(spark, tmp_path, mode):
    rows = random_histories(60, COURSES, seed=19)
    df = frame(spark, rows).coalesce(1).cache()
    options = {"rules": RULES, "mode": mode, "tiebreak": ["seq"]}
    terms = sorted({r["strm"] for r in rows})
    terms = terms if mode == "latest" else terms[-5:]
    eligibility_state(df.where(f"strm <= '{terms[2]}'"), **options).write.parquet(str(tmp_path / terms[2]))
    for before, term in zip(terms[2:], terms[3:]):
        state = advance_state(spark.read.parquet(str(tmp_path / before)), df, term, **options)
        state.write.parquet(str(tmp_path / term))
        state, so_far = spark.read.parquet(str(tmp_path / term)), df.where(f"strm <= '{term}'")
        assert cells(matrix_of_state(state, term, RULES)) == cells(student_matrix(so_far, last_term=term, **options))
        whole = eligibility_state(so_far, **options)
        assert sorted(map(tuple, state.select(*whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_an_increment_reads_the_new_term_alone(spark, tmp_path):
    df = frame(spark, random_histories(20, COURSES, seed=20))
    df.write.partitionBy("strm").parquet(str(tmp_path / "h"))
    hist = spark.read.schema(df.schema).parquet(str(tmp_path / "h"))
    state = eligibility_state(hist.where(f"strm < '{LAST}'"), tiebreak=["seq"])
    state.write.parquet(str(tmp_path / "s"))
    plan = advance_state(spark.read.parquet(str(tmp_path / "s")), hist, LAST, tiebreak=["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and f"(strm#" in plan and f"= {LAST})" in plan


def test_no_rules_and_no_rows(spark):
    df = frame(spark, term_rows([("5227", 30), (LAST, 40)]))
    assert student_matrix(df, [], last_term=LAST).collect() == []
    assert student_matrix(df.limit(0), RULES, last_term=LAST, tiebreak=["seq"]).collect() == []
    assert eligibility_state(df.limit(0), RULES).collect() == []
