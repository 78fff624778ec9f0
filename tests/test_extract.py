"""The extract operators against plain loops over small tables."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from coursepath.functions import pad_to
from coursepath.operators.cohort import admissions_list, census_cohort, census_listing, earliest_admit
from coursepath.operators.history import (
    attach_class,
    build_extract,
    build_schedule,
    course_catalog,
    course_history,
    course_history_by_subject,
    with_lifetime_max,
)
from coursepath.operators.keys import (
    JoinGuard,
    common_keys,
    exclude,
    first_per_key,
    hot_keys,
    keys_only_in,
    repeated_keys,
    restrict_to,
    spread_join,
)
from coursepath.operators.rollup import class_rollup, student_classes
from coursepath.sources import SOURCE_SCHEMAS

TERMS = ["5227", "5243", "5327"]
STUDENTS = [f"{i:04d}" for i in range(12)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    classes = [
        {
            "class_nbr": str(n), "strm": t, "crse_id": f"c{n % 3}", "subject": s, "catalog_nbr": str(1000 + n % 3),
            "acad_group": "CBUSN" if n % 2 else "CARTS", "strm_sdesc": "T" + t,
        }
        for n in range(4)
        for t in TERMS
        for s in (["FINANC", "STAT"] if n == 3 else ["FINANC"])
    ]
    enrolment = [
        {
            "emplid": rng.choice(STUDENTS), "strm": rng.choice(TERMS), "class_nbr": str(rng.randint(0, 4)),
            "stdnt_enrl_status": rng.choice("EEEED"), "enrl_status_reason": rng.choice(["ENRL", "ENRL", "DROP"]),
            "grading_basis_enrl": rng.choice(["GRD", "GRD", "NON", None]),
            "repeat_code": rng.choice(["ORIG", "ORIG", "NING", None]), "crse_grade_off": rng.choice(["A", "F"]),
            "crse_grade_input": "", "grd_pts_per_unit": rng.choice([0.0, 3.0]), "unt_taken": 3.0, "acad_prog": "BUSNU",
        }
        for _ in range(160)
    ]
    credit = [
        {
            "emplid": rng.choice(STUDENTS), "crse_id": f"c{rng.randint(0, 3)}", "articulation_term": rng.choice(TERMS),
            "trnsfr_stat": rng.choice("YPN"), "crse_grade_off": rng.choice(["A", "C-", "D", None]),
        }
        for _ in range(60)
    ]
    progress = [
        {
            "emplid": s, "strm": t, "term": "T" + t, "acad_plan": p, "acad_subplan": "x", "cum_gpa": 3.0,
            "tot_cumulative": rng.choice([None, 10.0, 50.0, 90.0]),
        }
        for s, t in product(STUDENTS, TERMS)
        for p in rng.sample(["UNDEC_BUS", "ACCT_BSACC", "OTHER"], 2)
    ]
    census = [
        {
            "emplid": s, "strm": t, "acad_career": "UGRD", "um_deg_seeking": rng.choice("YYYN"),
            "um_acad_grp_descr": rng.choice(["College of Business", "College of Arts"]),
            "um_acad_prog1": rng.choice(["BUSNU", None]), "um_acad_prog3": rng.choice(["BUSNU", "ARTSU", None]),
            "um_clevel_descr": rng.choice(["SENIOR", "JUNIOR", "MASTERS"]), "admit_term": rng.choice(TERMS + [None]),
        }
        for s, t in product(STUDENTS, TERMS)
        if rng.random() < 0.8
    ]
    admissions = [
        {
            "emplid": s, "admit_term_rollup": rng.choice([None] + TERMS), "admit_type": rng.choice(["FTC", "TRE", "X"]),
            "um_deg_seeking": "Y", "acad_career": "UGRD", "acad_group": "CBUSN",
        }
        for s in STUDENTS[:9]
        for _ in range(2)
    ]
    return {
        "census": census, "enrolment": enrolment, "class_dim": classes, "progress": progress,
        "admissions": admissions, "transfer": credit[:40], "test_credit": credit[40:],
    }


@pytest.fixture(scope="module")
def src(spark, tables):
    out = {}
    for name, rows in tables.items():
        schema = SOURCE_SCHEMAS[name]
        values = [tuple(r.get(f) for f in schema.fieldNames()) for r in rows]
        out[name] = pad_to(spark.createDataFrame(values, schema), schema)
    return out


def rows_of(df, columns=None):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=key)


def sort(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def enrolled(t, repeats=True):
    return [
        e
        for e in t["enrolment"]
        if e["stdnt_enrl_status"] == "E" and e["enrl_status_reason"] == "ENRL"
        and e["grading_basis_enrl"] not in ("NON", None)
        and (not repeats or e["repeat_code"] not in ("NING", None))
    ]


def courses(t, ids):
    out = []
    for e in enrolled(t):
        for c in t["class_dim"]:
            if e["emplid"] in ids and (e["class_nbr"], e["strm"]) == (c["class_nbr"], c["strm"]):
                out.append((e["emplid"], e["strm"], c["subject"], c["catalog_nbr"], e["class_nbr"], e["grd_pts_per_unit"], "MU"))
    catalog = {(c["crse_id"], c["subject"], c["catalog_nbr"]) for c in t["class_dim"]}
    for name, tag in (("transfer", "TRANSFER"), ("test_credit", "TEST")):
        for r in t[name]:
            good = r["trnsfr_stat"] in "YP" and (tag == "TEST" or r["crse_grade_off"] in ("A", "C-"))
            if good and r["emplid"] in ids:
                out += [
                    (r["emplid"], r["articulation_term"], s, n, None, 99.0, tag) for i, s, n in catalog if i == r["crse_id"]
                ]
    return out


def program_ids(t, term):
    return {
        c["emplid"]
        for c in t["census"]
        if c["strm"] == term and c["um_deg_seeking"] == "Y" and "BUSNU" in (c["um_acad_prog1"], c["um_acad_prog3"])
    }


def first_admits(t):
    out = {}
    for a in t["admissions"]:
        if a["admit_type"] in ("FTC", "TRE"):
            out.setdefault(a["emplid"], []).append(a["admit_term_rollup"])
    return {s: min([v for v in terms if v is not None], default=None) for s, terms in out.items()}


COURSE_COLUMNS = ["emplid", "strm", "subject", "catalog_nbr", "class_nbr", "grd_pts_per_unit", "course_source"]


def test_cohort_rules(src, tables):
    group = {
        c["emplid"]
        for c in tables["census"]
        if c["strm"] == "5327" and c["um_deg_seeking"] == "Y" and c["um_acad_grp_descr"] == "College of Business"
    }
    assert {r.emplid for r in census_cohort(src["census"], "5327").collect()} == group
    got = census_cohort(src["census"], "5327", by="program").collect()
    assert len(got) == len({r.emplid for r in got}) and {r.emplid for r in got} == program_ids(tables, "5327")
    with pytest.raises(ValueError):
        census_cohort(src["census"], "5327", by="name")


def test_census_listing_puts_missing_terms_first(src):
    terms = [r.admit_term for r in census_listing(src["census"], "5327", 50).collect()]
    assert terms == sorted(terms, key=lambda t: (t is not None, [-ord(c) for c in t or ""]))
    assert census_listing(src["census"], "5327", 2, columns=["emplid"]).count() == 2


def test_earliest_admit(src, tables):
    got = {r.emplid: r.admit_term_rollup for r in earliest_admit(src["admissions"]).collect()}
    assert got == first_admits(tables) and None in got.values()
    assert admissions_list(src["admissions"], types=("X",)).where("admit_type <> 'X'").count() == 0


def test_course_history(src, tables):
    cohort = census_cohort(src["census"], "5327", by="program")
    got = course_history(src, cohort, "0000")
    assert rows_of(got, COURSE_COLUMNS) == sort(courses(tables, program_ids(tables, "5327")))
    later = course_history(src, None, "5243")
    assert later.where("course_source = 'MU' AND strm < '5243'").count() == 0
    assert later.where("course_source <> 'MU' AND strm < '5243'").count() > 0


def test_history_by_subject_equals_the_tagged_history(src):
    columns = ["strm", "emplid", "crse_id", "subject", "catalog_nbr", "crse_grade_off"]
    by_subject = course_history_by_subject(src, ["FINANC"], src["enrolment"]["strm"].isNotNull() | True)
    tagged = course_history(src, None, "0000").where("subject = 'FINANC'").select(*columns).distinct()
    assert rows_of(by_subject.select(*columns).distinct()) == rows_of(tagged)


def extract_rows(t, ids):
    admits, out = first_admits(t), []
    for c in courses(t, ids):
        levels = [d["um_clevel_descr"] for d in t["census"] if (d["emplid"], d["strm"]) == c[:2]] or [None]
        for p in t["progress"]:
            if (p["emplid"], p["strm"]) == c[:2] and p["acad_plan"] != "OTHER":
                out += [c + (p["acad_plan"], p["tot_cumulative"], admits.get(c[0]), v) for v in levels]
    most = {}
    for r in out:
        most[r[0]] = max(most.get(r[0], -1.0), -1.0 if r[8] is None else r[8])
    return {r + (None if most[r[0]] == -1.0 else most[r[0]],) for r in out}


def test_full_extract(src, tables):
    cohort = census_cohort(src["census"], "5327", by="program")
    got = build_extract(src, cohort, first_term="0000")
    columns = COURSE_COLUMNS + ["acad_plan", "tot_cumulative", "admit_term", "um_clevel_descr", "tot_hrs_life"]
    assert rows_of(got, columns) == sort(extract_rows(tables, program_ids(tables, "5327")))


def test_schedule_keeps_repeats_and_needs_every_attribute(src, tables):
    cohort = src["census"].select("emplid").distinct()
    got = build_schedule(src, cohort)
    ids, admits, want = {c["emplid"] for c in tables["census"]}, first_admits(tables), []
    for e in enrolled(tables, repeats=False):
        for c, p, d in product(tables["class_dim"], tables["progress"], tables["census"]):
            same = {(x["emplid"], x["strm"]) for x in (e, p, d)}
            if (
                len(same) == 1 and e["emplid"] in ids and e["emplid"] in admits
                and (c["class_nbr"], c["strm"]) == (e["class_nbr"], e["strm"])
                and p["acad_plan"] != "OTHER" and d["um_clevel_descr"] != "MASTERS"
            ):
                want.append((e["emplid"], e["strm"], c["subject"], e["class_nbr"], p["acad_plan"], p["tot_cumulative"]))
    most = {}
    for r in want:
        most[r[0]] = max(most.get(r[0], -1.0), -1.0 if r[5] is None else r[5])
    want = [r + (None if most[r[0]] == -1.0 else most[r[0]],) for r in want]
    columns = ["emplid", "strm", "subject", "class_nbr", "acad_plan", "tot_cumulative", "tot_hrs_life"]
    assert rows_of(got, columns) == sort(want)


def test_class_rollup_and_student_classes(src, tables):
    want = {}
    for e in enrolled(tables, repeats=False):
        for c in tables["class_dim"]:
            if e["strm"] == "5243" and (c["class_nbr"], c["strm"]) == (e["class_nbr"], "5243") and c["acad_group"] == "CBUSN":
                ids, total = want.get((c["class_nbr"], c["subject"]), (set(), 0.0))
                want[c["class_nbr"], c["subject"]] = (ids | {e["emplid"]}, total + 3.0)
    got = class_rollup(src["enrolment"], src["class_dim"], "5243").collect()
    assert {(r.class_nbr, r.subject): (r.enrl_tot, r.tot_credits) for r in got} == {
        k: (len(ids), total) for k, (ids, total) in want.items()
    }
    every = student_classes(src["enrolment"], src["class_dim"], "5243")
    one = student_classes(src["enrolment"], src["class_dim"], "5243", STUDENTS[0])
    assert rows_of(one) == rows_of(every.where(f"emplid = '{STUDENTS[0]}'"))


def test_attach_class_needs_both_keys(src):
    plain = attach_class(src["enrolment"].select("class_nbr", "strm"), src["class_dim"].where("subject = 'FINANC'"))
    assert plain.count() == src["enrolment"].count()
    catalog = course_catalog(src["class_dim"])
    assert catalog.count() == catalog.distinct().count() == 4


def test_keys(spark):
    a = spark.createDataFrame([("1", 2, "x"), ("1", 1, "y"), ("2", None, "z")], "emplid string, n int, v string")
    b = spark.createDataFrame([("1",), ("3",)], "emplid string")
    assert rows_of(first_per_key(a, ["emplid"], ["n"])) == [("1", 1, "y"), ("2", None, "z")]
    assert restrict_to(a, b).count() == 2 and exclude(a, b).count() == 1
    assert rows_of(common_keys(a, b)) == [("1",)] and rows_of(keys_only_in(a, b)) == [("2",)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_copy", [1, 15, 1000])
def test_spread_join_equals_the_plain_join(spark, how, rows_per_copy):
    df = spark.createDataFrame([(k, n) for k in ("1", "1", "2", None) for n in range(40)], "emplid string, n int")
    lookup = spark.createDataFrame([("1", "a"), ("1", "b"), ("3", "c"), (None, "d")], "emplid string, v string")
    want = rows_of(df.join(lookup, "emplid", how))
    hot = hot_keys(df, "emplid", rows_per_copy=rows_per_copy)
    assert rows_of(spread_join(df, lookup, "emplid", how, hot=hot)) == want
    assert rows_of(spread_join(df, lookup, ["emplid"], how, spread=["n"], hot=hot)) == want
    assert rows_of(spread_join(df, lookup, ["emplid"], how)) == want


def test_hot_keys_are_those_with_more_than_a_share(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.col("id").cast("string")).alias("emplid"), F.lit(1).alias("n")
    )
    hashes = {r.emplid: r.h for r in df.select("emplid", F.xxhash64("emplid").alias("h")).distinct().where("emplid in ('hot', 'warm')").collect()}
    found = hot_keys(df, "emplid", rows_per_copy=5000)
    assert found == {hashes["hot"]: 3, hashes["warm"]: 2}  # a share is an eighth of the rows here
    assert hot_keys(df, "emplid") == {} and hot_keys(df.limit(0), "emplid") == {}
    assert hot_keys(df.select(F.lit(None).cast("string").alias("emplid")), "emplid", rows_per_copy=10) == {}


def test_a_guard_counts_rows_in_the_job_of_the_join(spark):
    rows = spark.createDataFrame([(str(k), "5227") for k in (1, 1, 2, 3)], "class_nbr string, strm string")
    once = spark.createDataFrame([("1", "5227", "A"), ("2", "5227", "B")], "class_nbr string, strm string, subject string")
    guard = JoinGuard("classes")
    assert attach_class(rows, once, guard=guard).count() == 4
    guard.check()
    assert (guard.rows_in, guard.rows_out) == (4, 4)
    guard = JoinGuard("classes")
    out = attach_class(rows, once.union(once.where("class_nbr = '1'")), guard=guard)
    assert out.count() == 6 and (guard.rows_in, guard.rows_out) == (4, 6)
    with pytest.raises(ValueError, match="4 rows became 6"):
        guard.check()
    with pytest.raises(ValueError, match="one join"):
        guard.join(rows, once, ["class_nbr", "strm"], "left")


def test_repeated_keys(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "emplid string, v string")
    assert rows_of(repeated_keys(df, ["emplid"])) == [("1", 2)]


def test_ordered_extract(src):
    cohort = src["census"].select("emplid")
    rows = [(r.emplid, r.strm) for r in build_extract(src, cohort, first_term="0000", ordered=True).collect()]
    assert rows == sorted(rows) and rows
    rows = [(r.emplid, r.strm) for r in build_schedule(src, cohort, ordered=True).collect()]
    assert rows == sorted(rows) and rows


def test_lifetime_max_ignores_missing_hours(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "emplid string, tot_cumulative double")
    assert rows_of(with_lifetime_max(df)) == [("a", 1.0, 1.0), ("a", None, 1.0), ("b", None, None)]
