"""Tables with a key, of which a batch of changes reads and writes only the files that it touches.

Under the table's root lie its files, each of a range of keys, and versions of an index with a row for each file: the
smallest and largest key, rows, bytes, SHA-256, a Bloom filter of the keys, and the slices of the key's order that the file
has keys of. A slice is what one file had when the table was made.

A batch's keys are joined to slices (an as-of join) and through these to the files whose range and filter may hold them.
Only those files are read. Files that do hold a key are written anew, the others stay as they are, under the same name; keys
that no file holds go into files of their own. A new version of the index is the last to be written, and an index counts
once it is whole, so a run that breaks off leaves the table as it was. Old files stay for readers of old versions.

Keys are of one type with an order and aren't null; a batch says a key once. Writers take turns.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.asof import asof
from corpusloom.session import checkpointed
from corpusloom.sources import sinks

#: Rows of a file, bits of a filter for each key, and places in it that a key sets.
FILE_ROWS, KEY_BITS, PLACES = 1_000_000, 10, 5
HALF = 0x7FFFFFFF


def _halves(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return h.bitwiseAND(HALF), F.shiftrightunsigned(h, 33)


def may_hold(bloom: Column, key: Column) -> Column:
    """Whether a filter (array of words of 64 bits) may have been told the key."""
    a, b = _halves(key)
    bits = F.size(bloom).cast("bigint") * 64
    place = lambda i: (a + b * i) % bits
    held = [F.getbit(F.get(bloom, F.floor(place(i) / 64).cast("int")), (place(i) % 64).cast("int")) == 1 for i in range(PLACES)]
    out = held[0]
    for h in held[1:]:
        out &= h
    return out


def _filters(x: pd.DataFrame) -> pd.DataFrame:
    """The filter of one file, which has a bounded number of rows."""
    words = -(-len(x) * KEY_BITS // 64)
    bits = np.zeros(words * 64, bool)
    for i in range(PLACES):
        bits[(x["a"].to_numpy() + x["b"].to_numpy() * i) % len(bits)] = True
    return pd.DataFrame({"path": x["path"].iloc[:1].tolist(), "bloom": [np.packbits(bits, bitorder="little").view(np.int64).tolist()]})


def _listed(spark: SparkSession, folder: str, key: str, slices: DataFrame | None) -> DataFrame:
    """Index rows of the files in a folder; without slices each file is one."""
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col(key).alias("key"))
    a, b = _halves(F.col("key"))
    blooms = rows.select("path", a.alias("a"), b.alias("b")).groupBy("path").applyInPandas(_filters, "path string, bloom array<bigint>")
    if slices is None:
        ends = rows.groupBy("path").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("rows"), F.array(F.min("key")).alias("slices"))
    else:
        cut = asof(rows, slices, "key", "start")
        ends = cut.groupBy("path").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("rows"), F.array_sort(F.collect_set("start")).alias("slices"))
    sums = sinks.checksums(spark, folder).select(F.col("path").alias("_p"), "bytes", "sha256")
    name = lambda c: F.substring_index(c, "/", -2)  # noqa: E731  files of one task have one name in different folders
    return ends.join(blooms, "path").join(sums, name(F.col("path")) == name(F.col("_p"))).drop("_p")


def index(spark: SparkSession, root: str) -> DataFrame:
    """(path, lo, hi, rows, slices, bloom, bytes, sha256) of the current version's files."""
    return sinks.current(spark, f"{root}/index")


def _read(spark: SparkSession, files: DataFrame, empty) -> DataFrame:
    """The rows of some files with ``_path``; only the names reach the driver."""
    paths = [r["path"] for r in files.select("path").collect()]
    return (spark.read.parquet(*paths) if paths else spark.createDataFrame([], empty)).withColumn("_path", F.col("_metadata.file_path") if paths else F.lit(None).cast("string"))


def read(spark: SparkSession, root: str) -> DataFrame:
    schema = spark.read.parquet(f"{root}/schema").schema
    return _read(spark, index(spark, root), schema).drop("_path")


def create(df: DataFrame, root: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """df as a table whose files have about ``file_rows`` rows each."""
    spark = df.sparkSession
    folder = f"{root}/files/{uuid.uuid4().hex}"
    df = checkpointed(df)
    n = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(folder)
    df.limit(0).write.mode("overwrite").parquet(f"{root}/schema")
    sinks.replace(_listed(spark, folder, key, None), f"{root}/index")


def holding(spark: SparkSession, root: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, path): the files that may hold each key."""
    known = index(spark, root)
    slices = known.select(F.explode("slices").alias("start")).distinct()
    least = slices.agg(F.min("start").alias("_least"))
    cut = asof(keys.select(F.col(key).alias("key")), slices, "key", "start").crossJoin(F.broadcast(least))
    files = known.select("path", "lo", "hi", "bloom", F.explode("slices").alias("slice"))
    return cut.withColumn("slice", F.coalesce("start", "_least")).join(files, "slice").where(F.col("key").between(F.col("lo"), F.col("hi")) & may_hold(F.col("bloom"), F.col("key"))).select("key", "path")


def upsert(spark: SparkSession, root: str, batch: DataFrame, key: str, gone: DataFrame | None = None, file_rows: int = FILE_ROWS) -> dict[str, int]:
    """Puts a batch's rows in place of those of the same key, adds those of new keys, and takes out the keys of ``gone``.
    Returns how many files there were, how many were read and how many were written."""
    batch = checkpointed(batch)
    keys = batch.select(key) if gone is None else batch.select(key).unionByName(gone.select(key)).distinct()
    keys = checkpointed(keys)
    known = index(spark, root)
    touched = checkpointed(holding(spark, root, keys, key).select("path").distinct())
    old = _read(spark, touched, spark.read.parquet(f"{root}/schema").schema)
    held = checkpointed(old.select(F.col(key), "_path").join(keys, key))  # filters err, files don't
    folder = f"{root}/files/{uuid.uuid4().hex}"
    changed = held.select("_path").distinct()
    stay = old.join(changed, "_path", "left_semi").join(keys, key, "left_anti")
    new = batch.join(held.select(key, "_path"), key, "left")
    columns = [c for c in batch.columns]
    again = stay.select(*columns, "_path").unionByName(new.where("_path IS NOT NULL").select(*columns, "_path"))
    # a file's rows come from one file, so a task holds no more than that and the batch's rows of it
    again = again.withColumn("came_from", F.md5("_path")).drop("_path")
    again.repartition("came_from").sortWithinPartitions("came_from", key).write.partitionBy("came_from").option("compression", "zstd").parquet(f"{folder}/again")
    added = checkpointed(new.where("_path IS NULL").select(*columns))
    n = -(-added.count() // file_rows)
    if n:
        added.repartitionByRange(n, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{folder}/new")
    slices = checkpointed(known.select(F.explode("slices").alias("start")).distinct())
    least = slices.agg(F.min("start")).first()[0]
    parts = [known.join(changed.select(F.col("_path").alias("path")), "path", "left_anti")]
    written = 0
    for part in (["again"] if changed.head(1) else []) + (["new"] if n else []):
        if not spark.read.parquet(f"{folder}/{part}").head(1):
            continue
        made = checkpointed(_listed(spark, f"{folder}/{part}", key, slices))
        written += made.count()
        # keys under the first slice are its own
        first = F.array(F.lit(least))
        parts.append(made.withColumn("slices", F.when(F.col("lo") < F.lit(least), F.array_union(first, F.col("slices"))).otherwise(F.col("slices"))))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    before, were_read = known.count(), touched.count()
    sinks.replace(whole, f"{root}/index")
    return {"files": before, "read": were_read, "written": written}
