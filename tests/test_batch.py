from pyspark.sql import functions as F

from checks.adapter import FIRST_TERM, LAST_TERM, REFERENCE_TERM, history, sources
from coursepath.fixed_values import BASE_COLUMNS, BASE_COLUMNS_V1, WIDE_COLUMNS_V1
from coursepath.operators.rules import CURRENT_RULES
from coursepath.plans import crosstab_batch, eligibility_batch, eligibility_batch_v1, extract_batch
from coursepath.sources import read_history


def read(spark, path):
    return spark.read.option("header", True).csv(path)


def test_extract_feeds_the_eligibility_job(spark, sf_dir, tmp_path):
    src = sources(spark, sf_dir)
    extract_batch(src, REFERENCE_TERM, str(tmp_path / "extract"), first_term=FIRST_TERM)
    extract = read_history(spark, str(tmp_path / "extract"))
    assert extract.count() > 0 and extract.where("admit_term IS NULL OR acad_prog IS NULL").count() == 0

    tiebreak = ["subject", "catalog_nbr", "class_nbr", "acad_subplan"]
    out = str(tmp_path / "eligibility")
    eligibility_batch(extract, REFERENCE_TERM, out, tiebreak=tiebreak)
    wide = read(spark, f"{out}/wide")
    targets = [r.target for r in CURRENT_RULES]
    assert wide.columns == list(BASE_COLUMNS) + [c for t in targets for c in (t, t + "_SEM_ELI")]
    students = extract.where(F.col("strm") == REFERENCE_TERM).select("emplid").distinct().count()
    assert wide.count() == students > 0
    stats = {r["target"]: r for r in read(spark, f"{out}/statistics").collect()}
    assert list(stats) == targets and f"enrolled_{REFERENCE_TERM}" in stats["FINANC_3000"].asDict()
    lists = read(spark, f"{out}/eligible_not_enrolled")
    for target in ("FINANC_3000", "MRKTNG_3000", "MANGMT_3000"):
        n = lists.where(F.col("target") == target).count()
        assert n == int(stats[target]["elig_never_enrolled"])

    eligibility_batch_v1(extract, REFERENCE_TERM, str(tmp_path / "v1"), tiebreak=tiebreak)
    v1 = read(spark, str(tmp_path / "v1"))
    assert v1.columns == list(BASE_COLUMNS_V1) + [c for n in WIDE_COLUMNS_V1 for c in (n, n + "_SEM_ELI")]
    assert v1.count() == students


def test_crosstab_job(spark, sf_dir, tmp_path):
    crosstab_batch(history(spark, sf_dir), LAST_TERM, str(tmp_path))
    assert read(spark, f"{tmp_path}/students_by_level").count() == 4
    assert read(spark, f"{tmp_path}/overlap_totals").count() == 6
    assert read(spark, f"{tmp_path}/overlap_exclusive").count() == 5
    assert read(spark, f"{tmp_path}/plan_levels").count() == 3
    assert [r.acad_subplan for r in read(spark, f"{tmp_path}/subplan_levels").collect()][-2:] == ["FIN_BANK", "REAL_EST"]
