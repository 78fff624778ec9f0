import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from coursepath.functions import (
    any_of_equals,
    class_key,
    clean_catalog_nbr,
    coerce_number,
    level_or_label,
    normalise_headers,
    pad_to,
    strip_suffix,
    suffix_of,
    with_class_key,
    with_plan_flag,
)


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "c string").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "number,clean", [("_0110", "0110"), ("1014W", "1014"), ("12345W", "1234"), ("W", "0000"), ("", "0000")]
)
def test_catalog_number(spark, number, clean):
    assert value(spark, clean_catalog_nbr, number) == clean


def test_class_key_is_upper_case_and_never_null(spark):
    df = spark.createDataFrame(
        [("stat", "_1200"), ("BUS_AD", "x"), (None, "2500"), ("A", None)], "subject string, catalog_nbr string"
    )
    keys = [r["class"] for r in with_class_key(df).collect()]
    assert keys == ["STAT_1200", "BUS_AD_0000", "_2500", "A_0000"]
    other = df.select(class_key(F.col("subject"), F.col("catalog_nbr"), "").alias("k")).collect()
    assert [r.k for r in other] == ["STAT_1200", "BUS_AD_", "_2500", "A_"]


@pytest.mark.parametrize(
    "text,number",
    [
        ("3", 3.0), (" 2.5 ", 2.5), ("-1e2", -100.0), (".5", 0.5), ("", None), ("A-", None), ("1d", None),
        ("2.0F", None), ("nan", None), ("NaN", None), ("inf", float("inf")), (None, None),
    ],
)
def test_coerce_number(spark, text, number):
    assert value(spark, coerce_number, text) == number


@pytest.mark.parametrize(
    "name,head,tail",
    [("BUS_AD_1500_28", "BUS_AD_1500", "28"), ("STAT_", "STAT", ""), ("STAT", "STAT", ""), ("_", "", "")],
)
def test_suffix(spark, name, head, tail):
    assert value(spark, strip_suffix, name) == head
    assert value(spark, suffix_of, name) == tail


def test_any_of_equals_keeps_unknown(spark):
    df = spark.createDataFrame([("X", None), (None, "Y"), ("Z", "Y")], "a string, b string")
    assert [r[0] for r in df.select(any_of_equals(["a", "b"], "X")).collect()] == [True, None, False]


def test_plan_flag_and_level_label(spark):
    df = spark.createDataFrame([("ACCT_BSACC",), ("OTHER",), (None,)], "acad_plan string")
    assert [r.bus_maj for r in with_plan_flag(df).collect()] == [1, 0, 0]
    assert value(spark, level_or_label, None) == "TRANS/TEST"


def test_headers_and_padding(spark):
    df = spark.createDataFrame([("1", 2)], "A string, b int")
    assert normalise_headers(df).columns == ["a", "b"]
    assert normalise_headers(df, "upper").columns == ["A", "B"]
    schema = StructType(
        [StructField("b", DoubleType()), StructField("z", StringType()), StructField("A", IntegerType())]
    )
    padded = pad_to(df, schema)
    assert [f.dataType for f in padded.schema] == [DoubleType(), StringType(), IntegerType()]
    assert tuple(padded.first()) == (2.0, None, 1)
