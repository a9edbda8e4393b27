"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests, local mode) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    own = spark.conf.get("foliospark.shared.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = f"file://{path}"
        spark.conf.set("foliospark.shared.dir", own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The table stays there until it is discarded or the folder is cleaned, as the result may be read at any time; an own folder
    goes with the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliospark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a frame that materialize made, once nothing will read it again; nothing for other frames."""
    path = getattr(df, "_foliospark_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
