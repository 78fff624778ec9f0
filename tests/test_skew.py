"""One student holds a third of all rows, and one class most of the rest."""

import pytest
from pyspark.sql import functions as F

from checks.adapter import build_history
from coursepath.functions import with_class_key
from coursepath.operators.eligibility import student_matrix
from coursepath.operators.history import with_lifetime_max
from coursepath.operators.rules import CURRENT_RULES
from coursepath.operators.status import student_base

LAST = "5427"
N = 300_000


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    student = F.when(i % 3 == 0, F.lit("00000000")).otherwise(F.lpad((i % 5000).cast("string"), 8, "0"))
    term = F.element_at(F.array(*[F.lit(f"{y}{s}") for y in range(52, 55) for s in ("27", "35", "43")]), (F.hash("id") % 9 + 9).cast("int") % 9 + 1)
    course = F.element_at(F.array(*[F.lit(c) for c in ("STAT", "FINANC", "MRKTNG")]), (i % 7 % 3 + 1).cast("int"))
    return with_class_key(
        spark.range(0, N, 1, 16).select(
            student.alias("emplid"),
            term.alias("strm"),
            course.alias("subject"),
            F.when(course == "STAT", "2500").otherwise("3000").alias("catalog_nbr"),
            F.when(i % 5 == 0, 0.0).otherwise(3.0).alias("grd_pts_per_unit"),
            F.lit("").alias("crse_grade_input"),
            (i % 60).cast("double").alias("tot_cumulative"),
            F.lit("JUNIOR").alias("um_clevel_descr"),
            F.lit(1).alias("bus_maj"),
            i.alias("seq"),
        )
    )


def test_hot_student_arrives_as_one_row_per_term(spark, skewed):
    matrix = student_matrix(skewed, CURRENT_RULES, last_term=LAST, tiebreak=["seq"])
    rows = matrix.collect()
    students = {r.emplid for r in rows}
    assert "00000000" in students and len(rows) == len(students) * len(CURRENT_RULES)
    hot = {r.target: (r.status, r.sem_eli) for r in rows if r.emplid == "00000000"}
    last = skewed.where("emplid = '00000000' AND class = 'FINANC_3000'").orderBy(F.desc("strm"), F.desc("seq")).first()
    assert hot["FINANC_3000"][0] == (2 if last.grd_pts_per_unit > 0 else 1)
    # MANGMT_3000 is never taken; 28 hours are met in the first term: 8 later terms less 3 summers.
    terms = skewed.where("emplid = '00000000'").select("strm").distinct().count()
    assert terms == 9 and hot["MANGMT_3000"] == (0, 5)


def test_attaching_the_lifetime_maximum_keeps_every_row(skewed):
    out = with_lifetime_max(skewed).agg(F.count("*"), F.sum("tot_hrs_life"), F.min("tot_hrs_life")).first()
    assert out[0] == N
    assert out[1] == skewed.groupBy("emplid").agg(F.count("*").alias("n"), F.max("tot_cumulative").alias("m")).agg(
        F.sum(F.col("n") * F.col("m"))
    ).first()[0]


def test_base_of_a_hot_student_is_one_row(skewed):
    base = student_base(skewed, LAST, ["emplid", "strm", "seq"], ["seq"])
    hot = base.where("emplid = '00000000'").collect()
    first = skewed.where(f"emplid = '00000000' AND strm = '{LAST}'").agg(F.min("seq")).first()[0]
    assert [r.seq for r in hot] == [first]


def test_history_of_a_hot_customer_and_order(spark, sf_dir, tmp_path):
    """A third of the lines sit on one order and a third of the orders on one customer."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines, orders = read("lineitem"), read("orders")
    hot_order = orders.agg(F.min("o_orderkey")).first()[0]
    hot_customer = orders.agg(F.min("o_custkey")).first()[0]
    lines = lines.withColumn("l_orderkey", F.when(F.col("l_suppkey") % 3 == 0, hot_order).otherwise(F.col("l_orderkey")))
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, hot_customer).otherwise(F.col("o_custkey")))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("customer", "part"):
        read(name).write.parquet(str(tmp_path / f"{name}.parquet"))
    hist = build_history(spark, str(tmp_path))
    total = hist.agg(F.count("*"), F.max("tot_cumulative")).first()
    assert total[0] == lines.count()
    most = hist.groupBy("emplid").count().agg(F.max("count")).first()[0]
    assert most > total[0] / 3 and total[1] == 3.0 * most
