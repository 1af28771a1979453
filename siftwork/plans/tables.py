"""Tables in the cluster's shared folder: where iterative plans cut their lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all
    runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="siftwork-")
    return "file://" + _own_dirs[app]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application in the shared folder; deleted when the driver ends."""
    top = f"{shared_dir(spark)}/siftwork-{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_delete, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, but for those made with keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = table_path(spark, name)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
