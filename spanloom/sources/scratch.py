"""Tables written between steps, in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share.

    Where that setting is missing, a session on one machine (tests) gets a temporary folder, a cluster its warehouse, which
    then has to be a shared one: a local warehouse on a cluster raises, as each machine would write to its own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        alone = re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master)
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not alone and re.match(r"file:|/", house):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-") if alone else f"{house}/scratch")
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: lineage ends here and executors may go."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete what written() wrote for these tables, once nothing reads them any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
