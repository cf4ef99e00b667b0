"""Tables that cut a lineage: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir()
    return root.rstrip("/")


#: Folders of the tables staged in each scope that is open, the innermost last.
_scopes: list[list[str]] = []


#: While this holds, the shuffle files of a query go once it has run.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written into the shared folder and read again, which survives lost executors. `clear` removes what was staged."""
    table, path = _written(df, label)
    if _scopes:
        _scopes[-1].append(path)
    return table


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() gives, staged; all tables that were staged on the way to it are removed once it is written.

    Inside another such call it is one of the tables on the way itself.
    """
    _scopes.append([])
    try:
        table, path = _written(make(), label)
    finally:
        for on_the_way in _scopes.pop():
            _remove(spark, on_the_way)
    if _scopes:
        _scopes[-1].append(path)
    return table


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(table: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        _remove(table.sparkSession, files[0].rsplit("/", 1)[0])


def clear(spark: SparkSession) -> None:
    """Removes all tables that were staged in the shared folder, once no result is read from them any more."""
    _remove(spark, f"{shared_dir(spark)}/staged")
