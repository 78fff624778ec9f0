"""Small fixed tables (rules, level order, target lists) as local relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, **columns) -> DataFrame:
    """A local relation from equally long Python lists, one per column.

    Its size is known to the optimizer, so a join broadcasts it by its size.
    """
    return spark.createDataFrame(pa.table(columns))
