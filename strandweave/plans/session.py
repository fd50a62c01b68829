"""What every job needs from its session: tables, lineage cuts and partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the context's checkpoint folder, which all executors share. Where both are
    unset, one of our own if driver and executors are one process (tests); on a cluster that is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-strandweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back: the lineage ends there and no executor's loss can
    take the rows away. Parquet keeps these tables several times smaller than checkpoint() does; ``codec`` compresses them
    otherwise than the session does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete the tables behind results of ``cut`` that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_checked(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``max_rows`` rows, else as it is (an ordinary join then). It is counted
    here, at most up to that bound, so it should be cheap to read: a table or the result of ``cut``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
