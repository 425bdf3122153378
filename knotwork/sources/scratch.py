"""Tables in shared storage that cut a plan's lineage.

Results of steps and loop rounds are written as Parquet under the folder in ``spark.checkpoint.dir`` and read back; a
lost executor loses none of them. The shuffle files of a step are removed once its table is written, and rows go to
Python in small batches, so that long texts do not fill a worker. Only a session on a local master may lack the
setting, as in tests; it then gets a folder under /tmp/checkpoints.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Held while a step is written.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or on a local master a new one under /tmp/checkpoints where none is set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        os.makedirs(given, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def saved(df: DataFrame, tag: str = "round") -> DataFrame:
    """``df``, written once and reread."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
