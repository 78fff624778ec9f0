"""Session settings and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Let AQE split a hot join key even where that costs one more shuffle. Shuffled tasks of 16 MB, which are 100 MB or more as
# rows, sort in memory, where Spark's 64 MB may spill; so do scans of 16 MB aggregate, where Spark's 128 MB hold millions of groups.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
}

_local_dirs: dict[str, str] = {}
_derived: dict[tuple, tuple[str, object]] = {}
_to_remove: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Turn on skew handling and small tasks, except for what the session already sets itself."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can reach.

    A local session has no other machine, so there a temporary folder serves if the setting is missing. On a
    cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="coursepath-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table of this application; the tables go when the application ends."""
    root = f"{shared_dir(spark)}/coursepath/{spark.sparkContext.applicationId}"
    if root not in _to_remove:
        _to_remove.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder now, and read it back. Cuts the lineage; what reads it twice evaluates it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of whichever file system the path names; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        remove_path(spark, root)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder then stays for the cluster to clear
        return


def _files_mark(spark: SparkSession, paths: list[str]) -> tuple:
    """Changes when a file under the paths is added, removed or written again. Only listings are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    mark = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return tuple(mark)


def derived_table(
    spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]
) -> DataFrame:
    """Write ``build()`` as Parquet once per application and state of its input files, then read it back.

    The written table cuts the lineage and outlives lost executors. Changed inputs are built anew.
    """
    key = (spark.sparkContext.applicationId, name, *inputs, *_files_mark(spark, inputs))
    if key not in _derived:
        path = scratch_path(spark, name)
        table = build()
        table.write.parquet(path)
        _derived[key] = (path, table.schema)
    path, schema = _derived[key]
    return spark.read.schema(schema).parquet(path)
