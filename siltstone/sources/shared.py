"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: what the session names in ``spark.checkpoint.dir``.

    Only on one machine (a local master) a temporary folder is made where that is unset; on a cluster this is an error,
    as executors would write to folders of their own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(path)
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A URI below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
