"""Tables written between the rounds of an iterative operator: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, or, where the session names none, one under the warehouse.

    A warehouse on the driver's own disk is shared in local mode only; elsewhere the session must name a folder.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here:
        return here.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which `drop_scratch` removes."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this driver; results that still read them must have been written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
