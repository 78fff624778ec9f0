import pytest
from pyspark.sql import functions as F

from coursepath import fixed_values as fv
from coursepath.operators.cohort import census_listing
from coursepath.operators.rules import CURRENT_RULES, Rule, rules_from_table, rules_table
from coursepath.session import derived_table, shared_dir, tune
from coursepath.sources import (
    HISTORY_SCHEMA,
    SOURCE_SCHEMAS,
    export_eligible,
    load_sources,
    preview,
    read_history,
    read_rules,
    scan_csv,
    write_csv,
)


def test_csv_history_keeps_zeros_blanks_and_bad_numbers(spark, tmp_path):
    file = tmp_path / "history.csv"
    file.write_text(
        "STRM,EMPLID,Subject,CATALOG_NBR,GRD_PTS_PER_UNIT,CRSE_GRADE_INPUT,SEQ\n"
        '5343,0012,STAT,0110,3.0,"A, say ""B""",1\n'
        "5343,0013,,NA,absent,,2\n"
    )
    df = read_history(spark, str(file), "csv", extra=["seq"])
    assert df.columns == HISTORY_SCHEMA.fieldNames() + ["seq"]
    first, second = df.orderBy("emplid").collect()
    assert (first.emplid, first.catalog_nbr, first.grd_pts_per_unit) == ("0012", "0110", 3.0)
    assert first.crse_grade_input == 'A, say "B"'
    assert (second.subject, second.catalog_nbr, second.crse_grade_input) == ("", "NA", "")
    assert second.grd_pts_per_unit is None and second.acad_plan == "" and second.seq == "2"


def test_parquet_history_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([("0012", float("nan"), None)], "EMPLID string, cum_gpa double, acad_plan string").write.parquet(path)
    (row,) = read_history(spark, path).collect()
    assert (row.emplid, row.cum_gpa, row.acad_plan) == ("0012", None, "")


def test_csv_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("0012", 'a "b", c', None), ("0013", "", 1.5)], "emplid string, term string, cum_gpa double")
    write_csv(df, str(tmp_path / "out"))
    back = read_history(spark, str(tmp_path / "out"), "csv").select("emplid", "term", "cum_gpa")
    assert sorted(tuple(r) for r in back.collect()) == [("0012", 'a "b", c', None), ("0013", "", 1.5)]


def test_plain_rule_table_takes_known_conditions(spark, tmp_path):
    file = tmp_path / "rules.csv"
    file.write_text("Class,CondReq,Ord\nengl_1000,0,1\nFINANC_3000,1,2\nNEW_1000,1,3\nengl_1000,1,4\n,1,5\nNEW_1000,1,3\n")
    rules = {r.target: r for r in rules_from_table(read_rules(spark, str(file)))}
    assert list(rules) == ["ENGL_1000", "FINANC_3000", "NEW_1000"]
    assert rules["ENGL_1000"].unconditional
    assert rules["FINANC_3000"] == next(r for r in CURRENT_RULES if r.target == "FINANC_3000")
    assert not rules["NEW_1000"].states_condition and not rules["NEW_1000"].unconditional


def test_rows_of_a_target_that_disagree_are_an_error(spark, tmp_path):
    for name, need in (("a", 0), ("b", 1)):
        (tmp_path / f"{name}.csv").write_text(f"class,condreq\nX_1000,{need}\n")
    with pytest.raises(ValueError, match="X_1000"):
        rules_from_table(read_rules(spark, str(tmp_path)))


def test_csv_files_with_other_column_orders_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('EMPLID,STRM,ACAD_PLAN\n0001,5343,"x\ny"\n')
    (tmp_path / "b.csv").write_text("acad_plan,Strm,emplid,term\nP2,5344,0002,T\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted(tuple(r) for r in read_history(spark, str(tmp_path), "csv").select("emplid", "strm", "acad_plan", "term").collect())
    assert got == [("0001", "5343", "x\ny", ""), ("0002", "5344", "P2", "T")]


def test_full_rule_table_survives_a_file(spark, tmp_path):
    write_csv(rules_table(spark, CURRENT_RULES), str(tmp_path / "rules"))
    back = rules_from_table(read_rules(spark, str(tmp_path / "rules")), conditions=())
    assert set(back) == set(CURRENT_RULES)


def test_many_rules_load_and_count_alike(spark):
    from coursepath.operators.eligibility import eligible_terms

    from .data import frame, random_histories

    rules = [Rule(f"T_{k}", min_hours=float(k % 60)) for k in range(150)]
    assert set(rules_from_table(rules_table(spark, rules).union(rules_table(spark, rules)), ())) == set(rules)
    hist = frame(spark, random_histories(6, ["T_1", "T_100"], 3))
    last = hist.agg({"strm": "max"}).first()[0]
    got = eligible_terms(hist, rules, last_term=last).where("target in ('T_1', 'T_100')").collect()
    one = eligible_terms(hist, [rules[1], rules[100]], last_term=last).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, one))


@pytest.mark.parametrize("multi_line", [True, False])
def test_malformed_rows_go_to_the_quarantine(spark, tmp_path, multi_line):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("EMPLID,STRM,ACAD_PLAN\n0001,5343,P1\n0002,5343\n0003,5343,P1,more\n\n0004,5343,\n")
    (tmp_path / "in" / "b.csv").write_text("\ufeffStrm,emplid\n5344,0005\n5344,0006,x\n")
    (tmp_path / "in" / "c.csv").write_text("emplid\n0007\n")
    (tmp_path / "in" / "d.csv").write_text("EMPLID,STRM,ACAD_PLAN\n")
    read = lambda **more: sorted(tuple(r) for r in read_history(spark, str(tmp_path / "in"), "csv", multi_line=multi_line, **more).select("emplid", "strm", "acad_plan").collect())
    good = [("0001", "5343", "P1"), ("0004", "5343", ""), ("0005", "5344", ""), ("0007", "", "")]
    assert read(quarantine=str(tmp_path / "bad")) == good
    bad = sorted((r.file.rsplit("/", 1)[1], r.record) for r in spark.read.parquet(str(tmp_path / "bad")).collect())
    assert bad == [("a.csv", "0002,5343"), ("a.csv", "0003,5343,P1,more"), ("b.csv", "5344,0006,x")]
    assert read() == sorted([*good, ("0002", "5343", ""), ("0003", "5343", "P1"), ("0006", "5344", "")])


def test_repeated_and_blank_column_names_and_no_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,,X,"y z"\n1,2,3,4\n')
    scan = scan_csv(spark, str(tmp_path / "a.csv"))
    assert scan.rows.columns == ["x", "_c1", "x_2", "y z"] and [tuple(r) for r in scan.rows.collect()] == [("1", "2", "3", "4")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert read_history(spark, str(tmp_path / "none"), "csv").count() == 0


def test_ten_thousand_files_are_read_once_each(spark, tmp_path, monkeypatch):
    from coursepath.sources import readers

    (tmp_path / "in").mkdir()
    for k in range(10_000):
        header, row = ("emplid,strm", f"{k:05d},5343") if k % 2 else ("strm,emplid", f"5343,{k:05d}")
        (tmp_path / "in" / f"{k}.csv").write_text(f"{header}\n{row}\n" + ("torn\n" if k % 1000 == 0 else ""))
    plans, real = [], readers.stored_table
    monkeypatch.setattr(readers, "stored_table", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    rows = read_history(spark, str(tmp_path / "in"), "csv", multi_line=False, quarantine=str(tmp_path / "bad"))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert [plan.count("FileScan text") for plan in plans] == [1, 0, 0]
    assert rows.count() == rows.select("emplid").distinct().count() == 10_000 and rows.where("strm <> '5343'").count() == 0
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 10


def test_too_many_headers_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("coursepath.sources.readers.MOST_LAYOUTS", 2)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"c{k}\n1\n")
    with pytest.raises(ValueError, match="more than 2 different headers"):
        scan_csv(spark, str(tmp_path))


def test_warehouse_tables_keep_their_columns_and_get_the_needed_ones(spark, tmp_path):
    for name in SOURCE_SCHEMAS:
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text("EMPLID,STRM,Extra,GRD_PTS_PER_UNIT\n0012,5343,e,A-\n")
    src = load_sources(spark, str(tmp_path), "csv")
    for name, df in src.items():
        assert df.columns[: len(SOURCE_SCHEMAS[name])] == SOURCE_SCHEMAS[name].fieldNames() and "extra" in df.columns
    assert src["census"].first().um_acad_prog1 is None and src["enrolment"].first().grd_pts_per_unit is None
    assert preview(src["census"], 5, src["census"].strm == "5343").count() == 1
    assert len(fv.CENSUS_LISTING_COLUMNS) == 40 and census_listing(src["census"], "5343").columns == list(fv.CENSUS_LISTING_COLUMNS)


def test_export_writes_one_folder_per_target(spark, tmp_path):
    df = spark.createDataFrame([("s", "A_1000"), ("t", "A_1000"), ("u", "B_1000"), ("v", "C_1000")], "emplid string, target string")
    export_eligible(df, ["A_1000", "B_1000"], str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == ["target=A_1000", "target=B_1000"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def parts(folder):
    return sorted(p.name for p in folder.iterdir() if p.name.startswith("part-"))


def test_export_holds_few_files_and_a_rerun_replaces_its_targets_only(spark, tmp_path):
    out = tmp_path / "out"
    many = spark.range(0, 40_000, 1, 40).select(F.col("id").cast("string").alias("emplid"), F.concat(F.lit("T_"), F.col("id") % 8).alias("target"))
    export_eligible(many, [f"T_{k}" for k in range(8)], str(out))
    assert all(len(parts(out / f"target=T_{k}")) <= 2 for k in range(8))
    kept = {k: parts(out / f"target=T_{k}") for k in range(8)}

    def lost(n):
        raise RuntimeError("lost")

    from pyspark.sql.functions import udf

    broken = many.where("target in ('T_1', 'T_2')").withColumn("emplid", udf(lost)("emplid"))
    with pytest.raises(Exception, match="lost"):
        export_eligible(broken, ["T_1", "T_2", "T_3"], str(out))
    assert {k: parts(out / f"target=T_{k}") for k in range(8)} == kept

    export_eligible(many.where("target in ('T_1', 'T_2') and cast(emplid as int) < 800"), ["T_1", "T_2", "T_3"], str(out))
    again = spark.read.option("header", True).csv(str(out))
    counts = {r.target: r["count"] for r in again.groupBy("target").count().collect()}
    assert counts == {"T_0": 5000, "T_1": 100, "T_2": 100, "T_4": 5000, "T_5": 5000, "T_6": 5000, "T_7": 5000}
    assert {k: parts(out / f"target=T_{k}") for k in (0, 4, 5, 6, 7)} == {k: kept[k] for k in (0, 4, 5, 6, 7)}


def test_export_of_odd_names(spark, tmp_path):
    df = spark.createDataFrame([("s", "A/1 = 'x'"), ("t", "B")], "emplid string, target string")
    export_eligible(df, ["A/1 = 'x'", "B"], str(tmp_path / "out"), fmt="parquet")
    export_eligible(df.where("target = 'B'"), ["A/1 = 'x'", "B"], str(tmp_path / "out"), fmt="parquet")
    assert [r.target for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["B"]


def test_derived_table_is_written_once_for_each_state_of_its_inputs(spark, tmp_path):
    built, path = [], str(tmp_path / "in")

    def build():
        built.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    first = derived_table(spark, "probe", [path], build)
    second = derived_table(spark, "probe", [path], build)
    assert len(built) == 1 and first.count() == second.count() == 3
    assert all(shared_dir(spark) in f for f in second.inputFiles())
    spark.range(5).write.mode("append").parquet(path)
    assert derived_table(spark, "probe", [path], build).count() == 8 and len(built) == 2


def test_tune_leaves_explicit_settings_alone(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.unset(key)
    assert tune(spark).conf.get(key) == "true"
    spark.conf.set(key, "false")
    assert tune(spark).conf.get(key) == "false"
    spark.conf.unset(key)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
