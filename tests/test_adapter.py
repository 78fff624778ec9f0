"""The adapter's two derived tables, over rows of its own with gaps, repeats and orders without lines."""

import datetime as dt
import re

import pytest

from checks.adapter import build_history, classed_history, history, sources, student_orders
from checks.queries import QUERIES
from coursepath.session import tune

DAY = dt.datetime(1995, 3, 1)
TABLES = {
    "customer": ("c_custkey long, c_mktsegment string", [(1, "BUILDING"), (2, "HOUSEHOLD"), (3, None), (4, "OTHER"), (4, "MACHINERY"), (None, "BUILDING")]),
    "part": ("p_partkey long, p_size int", [(1, 0), (2, 23), (2, 5), (3, None), (4, 30), (5, -1), (None, 3)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
        [
            (1, 1, DAY, "1-URGENT"), (2, 1, DAY.replace(month=6), "2-HIGH"), (2, 1, DAY.replace(month=6), "2-HIGH"), (3, 2, DAY, None),
            (4, 3, None, "3-MEDIUM"), (5, 3, DAY, "3-MEDIUM"), (6, 4, DAY, "5-LOW"), (7, 2, DAY.replace(month=9), "5-LOW"), (8, 9, DAY, "5-LOW"),
            (None, 2, DAY, "5-LOW"), (9, None, DAY, "5-LOW"), (10, 1, DAY, "2-HIGH"),
        ],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string",
        [
            (order, part, 7 * order if order else None, line, flag, status)
            for order, parts in {1: (1, 2, 4), 2: (2, 2), 3: (1, 3), 4: (1, 4), 5: (4, None), 6: (2, 1), 8: (1,), 9: (1,), 10: (3, 5), None: (1,)}.items()
            for part in parts
            for line, flag, status in ((1, "N", "F"), (2, "A", "F"), (3, "A", "O"), (4, "R", "F"), (5, "R", "F"), (6, None, "F"), (None, "R", "F"), (7, "R", None))
        ],
    ),
}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def same(a, b) -> bool:
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_the_stored_history_is_the_one_of_the_lazy_plan(spark, odd_dir):
    lazy = build_history(spark, odd_dir)
    assert lazy.count() > 50 and same(history(spark, odd_dir), lazy)


def test_line_values_follow_flag_and_status(spark, odd_dir):
    found = build_history(spark, odd_dir).where("l_orderkey = 1 AND l_partkey = 1").select("l_linenumber", "grd_pts_per_unit", "crse_grade_input", "course_source")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0] or 9) == [
        (1, 2.0, "", "MU"), (2, 0.0, "F", "MU"), (3, 0.0, "", "MU"), (4, 99.0, "", "TEST"), (5, 99.0, "", "TRANSFER"), (6, 99.0, "", "MU"),
        (7, None, "", "MU"), (None, 99.0, "", "TEST"),
    ]


def test_orders_hold_what_their_lines_share(spark, odd_dir):
    shared = ["emplid", "strm", "acad_plan", "acad_subplan", "tot_cumulative", "um_clevel_descr"]
    orders, hist = student_orders(spark, odd_dir), build_history(spark, odd_dir)
    assert same(orders.select("l_orderkey", *shared).distinct(), hist.select("l_orderkey", *shared).distinct())


def scans(df) -> str:
    return " ".join(re.findall(r"(orders|history)-[0-9a-f]{32}", "".join(f for f in df.inputFiles())))


@pytest.mark.parametrize("name", ["census", "progress", "admissions"])
def test_what_concerns_no_course_needs_no_history(spark, odd_dir, name):
    view = sources(spark, odd_dir)[name]
    assert "orders" in scans(view) and "history" not in scans(view)


def test_a_cohort_stores_no_history(spark, odd_dir, monkeypatch):
    stored = []
    monkeypatch.setattr("checks.adapter.derived_table", lambda session, name, inputs, build: stored.append(name) or build())
    QUERIES["census_cohort_group"](spark, odd_dir).collect()
    assert stored == ["orders"]


def test_the_history_is_sorted_as_narrow_rows(spark, odd_dir, monkeypatch):
    monkeypatch.setattr("checks.adapter.derived_table", lambda session, name, inputs, build: build())

    def sorts(node) -> list[str]:
        below = [c for i in range(node.children().size()) for c in sorts(node.children().apply(i))]
        return below + ([node.output().mkString(" ")] if node.nodeName() == "Sort" else [])

    found = sorts(classed_history(spark, odd_dir)._jdf.queryExecution().optimizedPlan())
    assert any("l_linenumber" in x for x in found) and not any("um_clevel_descr" in x or "catalog_nbr" in x for x in found)


@pytest.mark.parametrize("key", ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"])
def test_tasks_are_small_unless_the_session_says_otherwise(spark, key):
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    assert tune(spark).conf.get(key) == "16m"
    spark.conf.set(key, "48m")
    assert tune(spark).conf.get(key) == "48m"
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)
