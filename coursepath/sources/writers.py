"""Sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import remove_path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_eligible(df: DataFrame, targets, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One ``target=<name>`` folder per target course, written in a single pass.

    Rows are dealt out by target first, large targets in several parts and small ones together, so each folder holds few
    files. Overwriting replaces the folders of ``targets`` alone: what a run for other targets wrote stays, a target without rows loses
    its folder, and a run that failed can be repeated.
    """
    written = Observation()
    rows = df.where(F.col("target").isin(*targets)).observe(written, F.collect_set("target").alias("targets"))
    writer = rows.hint("rebalance", "target").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("target")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
    if mode == "overwrite":
        for target in set(targets) - set(written.get["targets"] or []):
            remove_path(df.sparkSession, f"{path}/target={_folder(target)}")


def _folder(value: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)
