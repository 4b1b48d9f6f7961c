"""Raw objects by the hash of their content: each is stored once, many in a file, and read with one seek.

A pack is the objects of one task in the order of their SHA-256, each compressed by itself, end to end, and nothing else. The
index, a Parquet table in parts, sorted by hash, says for each object its pack, where it begins, how many bytes it takes
there and how many it has. Statistics of the index's row groups so lead to the one that has a hash, and the object costs one
seek and one read of its own bytes.

Objects that the index has are not written again. Packs have names of their own and count only by the index, whose part is
the last to be written: a task that runs twice or a run that breaks off leaves packs that nothing points to. Of writers at
the same time each writes what the index lacked when it began; of an object that two have written the copy in the pack of
the smaller name counts. Packs lie where Arrow's file systems reach. Null contents are no objects; empty ones are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpointed
from corpusloom.sources.discovered import file_system

INDEX = "sha256 string, pack string, begin bigint, stored bigint, bytes bigint"
#: Bytes of a pack, about; a task begins a new one beyond.
PACK_BYTES = 256 << 20


def _writer(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        codec, stream, name, at = pa.Codec("zstd"), None, "", 0
        for batch in batches:
            rows = []
            for sha, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stream is None or at >= most:
                    if stream:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.pack", 0
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                packed = codec.compress(content, asbytes=True)
                stream.write(packed)
                rows.append((sha, name, at, len(packed), len(content)))
                at += len(packed)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["sha256", "pack", "begin", "stored", "bytes"])
        if stream:
            stream.close()

    return write


def index(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, pack, begin, stored, bytes), once for each object; none where nothing is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], INDEX)
    rows = spark.read.schema(INDEX).parquet(f"{root}/index")
    return rows.groupBy("sha256").agg(F.min(F.struct("pack", "begin", "stored", "bytes")).alias("o")).select("sha256", "o.*")


def add(df: DataFrame, root: str, content: str, most: int = PACK_BYTES) -> int:
    """Stores the contents (binary or text) that aren't there yet; returns how many."""
    spark, c = df.sparkSession, F.col(content).cast("binary")
    rows = df.select(F.sha2(c, 256).alias("sha256"), c.alias("content")).where("content IS NOT NULL")
    # equal contents have equal hashes, so any copy will do; copies go before anything is shuffled
    fresh = rows.groupBy("sha256").agg(F.min("content").alias("content")).join(index(spark, root).select("sha256"), "sha256", "left_anti")
    dealt = fresh.repartitionByRange("sha256").sortWithinPartitions("sha256")
    made = checkpointed(dealt.select("sha256", "content").mapInArrow(_writer(f"{root}/packs", most), INDEX))
    n = made.count()
    if n:
        made.sortWithinPartitions("sha256").write.mode("append").option("compression", "zstd").parquet(f"{root}/index")
    return n


def _take(stream, begin: int, stored: int, n: int) -> bytes:
    stream.seek(begin)
    return pa.Codec("zstd").decompress(stream.read(stored), n, asbytes=True) if n else b""


def get(spark: SparkSession, root: str, sha256: str) -> bytes:
    """One object; KeyError if it isn't there. The filter reaches the index's row groups; of the pack the object's own
    bytes are read."""
    found = spark.read.schema(INDEX).parquet(f"{root}/index").where(F.col("sha256") == sha256).orderBy("pack").first()
    if found is None:
        raise KeyError(sha256)
    system, folder = file_system(f"{root}/packs")
    with system.open_input_file(f"{folder}/{found['pack']}") as stream:
        return _take(stream, found["begin"], found["stored"], found["bytes"])


def objects(wanted: DataFrame, root: str, sha256: str, into: str = "content") -> DataFrame:
    """wanted with the objects of its hashes, null where there is none. Rows are dealt out by pack and read in its order, so
    a task opens each of its packs once."""
    spark = wanted.sparkSession
    found = wanted.join(index(spark, root).withColumnRenamed("sha256", "_sha"), F.col(sha256) == F.col("_sha"), "left").drop("_sha")
    folder = f"{root}/packs"

    @F.arrow_udf("binary")
    def content(packs: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        system, top = file_system(folder)
        name, stream = None, None
        for pack, begin, stored, n in packs:
            out = []
            for p, a, k, m in zip(pack.to_pylist(), begin.to_pylist(), stored.to_pylist(), n.to_pylist()):
                if p is None:
                    out.append(None)
                    continue
                if p != name:
                    if stream:
                        stream.close()
                    name, stream = p, system.open_input_file(f"{top}/{p}")
                out.append(_take(stream, a, k, m))
            yield pa.array(out, pa.binary())
        if stream:
            stream.close()

    place = [F.col(c) for c in ("pack", "begin", "stored", "bytes")]
    # a pack may be asked for by most rows, and rows without an object go anywhere
    dealt = found.repartition("pack", F.floor(F.col("begin") / (8 << 20)), F.when(F.col("pack").isNull(), F.xxhash64(*wanted.columns))).sortWithinPartitions("pack", "begin")
    return dealt.withColumn(into, content(*place)).select(*wanted.columns, into)


def verified(content: Column, sha256: Column) -> Column:
    """The content if it has the hash."""
    return F.when(F.sha2(content, 256) == sha256, content)
