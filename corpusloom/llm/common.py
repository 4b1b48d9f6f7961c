"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.slices import SLICE_BYTES, arrow_slices, slices, text_udf  # noqa: F401
from corpusloom.session import load


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; a small one in fewer files than there are cores is dealt out to all of them."""
    return load(spark, sf_dir, name, spread=name in ("documents", "pages"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder
    of its own, and a cluster an error, as no folder of the driver's would be seen by executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder, which survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out_of(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores behind it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
