"""Writing tables: parts that are added, folders that are replaced as a whole, releases without texts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.discovered import file_system

#: Columns that hold texts of others and are never released.
TEXT_COLUMNS = frozenset({"title", "lead", "body", "title_original", "body_original", "text", "lemmas"})


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A part more; what is there stays."""
    w = df.write.mode("append").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def replace_days(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitions that df has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """An error if anything is there."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object for each row, nulls included, a line each."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, root: str) -> str:
    """df as the new version of the table at ``root``, also if df reads the current one: it is written beside it, and
    then an empty marker says that it is whole. A run that breaks off leaves the current version in force."""
    spark = df.sparkSession
    _, p, fs = _files(spark, root)
    n = 1 + max([int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")] if fs.exists(p) else [], default=0)
    path = f"{root}/v-{n:06d}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def _whole(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the folders in a folder that begin so and are written to the end, in order."""
    jvm, p, fs = _files(spark, folder)
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(x.getName() for x in found if x.getName().startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def exists(spark: SparkSession, root: str) -> bool:
    """There is a whole version at ``root``."""
    return bool(_whole(spark, root, "v-"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version at ``root``."""
    return spark.read.parquet(f"{root}/{_whole(spark, root, 'v-')[-1]}")


def _since(spark: SparkSession, root: str) -> str:
    """Where parts lie that came after the newest version; a new version begins with none."""
    versions = _whole(spark, root, "v-")
    return f"{root}/after-{versions[-1] if versions else 'nothing'}"


def add_part(df: DataFrame, root: str, number: int) -> None:
    """df as the part of that number beside the newest version; one written before under the number is replaced."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{_since(df.sparkSession, root)}/part-{number:012d}")


def parts(spark: SparkSession, root: str) -> int:
    return len(_whole(spark, _since(spark, root), "part-"))


def with_parts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest version and of the parts since."""
    since = _since(spark, root)
    paths = [f"{root}/{v}" for v in _whole(spark, root, "v-")[-1:]] + [f"{since}/{x}" for x in _whole(spark, since, "part-")]
    return spark.read.parquet(*paths)


def guarded(df: DataFrame) -> DataFrame:
    """df, if it has no column of texts."""
    leaked = sorted(TEXT_COLUMNS & set(df.columns))
    if leaked:
        raise ValueError(f"text columns are not released: {leaked}")
    return df


def release(df: DataFrame, path: str) -> None:
    """df without texts, as Parquet."""
    guarded(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


#: Bytes of a file that a task reads at once.
PIECE = 4 << 20


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            h = hashlib.sha256()
            system, name = file_system(path)
            with system.open_input_stream(name, compression=None) as stream:
                while piece := stream.read(PIECE):
                    h.update(piece)
            sums.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under the path, by path. Tasks read files of any size a piece at a time, through
    Arrow's file systems; no file's content becomes a value. Empty files are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    return files.mapInArrow(_summed, "path string, bytes bigint, sha256 string").orderBy("path")


def manifest(spark: SparkSession, path: str, name: str, made_at: str, notes: dict[str, str] | None = None) -> DataFrame:
    """What a release holds, as one row, and written as JSON beside it (path + ".manifest"): name, time, rows and columns of
    the table, its files with bytes and checksums, and notes (versions of rules, terms, models). An error if a text column
    has slipped in. Files are summed where they are read, whatever their size."""
    table = guarded(spark.read.parquet(path))
    files = checksums(spark, path).where(F.col("path").rlike(r"/part-[^/]*$")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
    listed = files.agg(F.array_sort(F.collect_list(F.struct("file", "bytes", "sha256"))).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type")) for c, t in table.dtypes])
    noted = F.create_map(*[F.lit(x) for kv in sorted((notes or {}).items()) for x in kv]) if notes else F.create_map().cast("map<string,string>")
    row = listed.crossJoin(F.broadcast(table.agg(F.count("*").alias("rows")))).select(F.lit(name).alias("name"), F.lit(made_at).alias("made_at"), "rows", "bytes", columns.alias("columns"), "files", noted.alias("notes"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.schema(row.schema).json(f"{path}.manifest")
