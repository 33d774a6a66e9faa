"""Session helpers: the shared scratch folder, tables that cut lineage, and their removal."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has made and not removed.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or a fresh folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it back, so that lost executors cost no recomputation.

    The table stays until release() or the end of the process.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for release(): how many tables there are now."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Removes the tables made since a mark, except for the last few. Call it when nothing that reads them will run again."""
    end = len(_MADE) - but
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for path in _MADE[since:end]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    del _MADE[since:end]


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
