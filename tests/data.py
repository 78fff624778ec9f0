"""Synthetic histories. Ids and values are made up."""

from __future__ import annotations

import random

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

SCHEMA = StructType(
    [
        StructField("emplid", StringType()),
        StructField("strm", StringType()),
        StructField("class", StringType()),
        StructField("grd_pts_per_unit", DoubleType()),
        StructField("grade_points", DoubleType()),
        StructField("crse_grade_input", StringType()),
        StructField("tot_cumulative", DoubleType()),
        StructField("um_clevel_descr", StringType()),
        StructField("bus_maj", IntegerType()),
        StructField("seq", IntegerType()),
    ]
)


def row(emplid, strm, cls, points=3.0, grade="", hours=0.0, level="FRESHMAN", flag=0, seq=0, grade_points=None):
    return {
        "emplid": emplid,
        "strm": strm,
        "class": cls,
        "grd_pts_per_unit": points,
        "grade_points": points if grade_points is None else grade_points,
        "crse_grade_input": grade,
        "tot_cumulative": hours,
        "um_clevel_descr": level,
        "bus_maj": flag,
        "seq": seq,
    }


def frame(spark, rows):
    def value(field, v):
        return float(v) if isinstance(field.dataType, DoubleType) and v is not None else v

    return spark.createDataFrame([tuple(value(f, r[f.name]) for f in SCHEMA.fields) for r in rows], SCHEMA)


def random_histories(n_students: int, courses, seed: int, terms=None):
    rng = random.Random(seed)
    terms = terms or [f"{y}{s}" for y in range(50, 55) for s in ("27", "35", "43")]
    levels = ["FRESHMAN", "SOPHOMORE", "JUNIOR", "SENIOR", ""]
    rows = []
    for i in range(n_students):
        hours = 0.0
        for strm in sorted(rng.sample(terms, rng.randint(1, len(terms)))):
            hours = max(0.0, hours + rng.choice([-3, 0, 3, 12, 15, 18]))
            level = rng.choice(levels)
            for k in range(rng.randint(1, 3)):
                points = rng.choice([None, -1.0, 0.0, 0.0, 2.0, 3.0, 99.0])
                rows.append(
                    row(
                        f"{i:07d}",
                        strm,
                        rng.choice(courses),
                        points,
                        rng.choice(["F", "f", "", "B"]),
                        rng.choice([hours, hours, None]),
                        level.lower() if rng.random() < 0.2 else level,
                        rng.choice([0, 0, 1]),
                        seq=k,
                        grade_points=rng.choice([None, -1.0, 0.0, 9.0]),
                    )
                )
                if rows[-1]["grade_points"] == points:
                    rows[-1]["grade_points"] = rng.choice([None, 0.0, 6.0])
    return rows


def by_student(rows):
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r["emplid"], []).append(r)
    return out
