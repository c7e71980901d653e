"""Work tables: rows written to the folder that the cluster shares and reread, which cuts lineage and survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it is removed when the application ends.

    Where that is unset, a temporary folder serves if the master is local; on a cluster it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "at" not in _own:
            _own["at"] = os.environ.get("BRINDLE_WORK") or tempfile.mkdtemp(prefix="brindle-")
        base = _own["at"]
    path = f"{base.rstrip('/')}/brindle-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a work folder."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone at exit; the folder is then the cluster's to clean
        return


def cut(df: DataFrame, *spent: DataFrame | None) -> DataFrame:
    """The rows of df as a work table. Work tables in `spent`, which nothing reads any more, are removed once it is written."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    for old in spent:
        if old is not None and (at := getattr(old, "_work_path", None)):
            drop(spark, at)
    return out
