"""Session settings that every operator relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Dates are taken in UTC, whatever the machine says; AQE splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS. ``more`` holds further settings, with dots written as two underscores."""
    b = SparkSession.builder.config(map=SETTINGS)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    require_utc(spark)
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError(f"dates are defined in UTC, but the session's zone is {zone}")


#: Bytes of a table that is small enough to be dealt out anew before costly work.
SMALL_TABLE = 64 << 20


def load(spark: SparkSession, folder: str, name: str, spread: bool = False):
    """The table ``name`` of a folder of Parquet tables. ``spread``: costly work follows, so a small table in fewer files
    than there are cores is dealt out to all of them; its files may be single row groups, which one task would read. Larger
    tables stay as they are."""
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() < SMALL_TABLE:
            df = df.repartition(cores)
    return df


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder
    of its own, and a cluster an error, as no folder of the driver's would be seen by executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df):
    """df with its lineage cut by files in the shared folder, which survive the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()
