"""The log as a stream: records are appended, readers want the latest of each unit.

Lateness is measured by when a record was written (``ingest_time``): a correction moves the time at which something
was valid back by months, and that doesn't make it late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import log as lg
from corpusloom.sources import sinks


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder or pattern as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(found: DataFrame, key: str = "url", time: str = "ingest_time", delay: str = "2 days") -> DataFrame:
    """Of each key the first row within the delay; state older than that is forgotten."""
    return found.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(log: DataFrame, time: str, by: list[str], width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows of each window of time and group."""
    rows = log.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def append_once(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, written as Parquet in batches; a run that breaks off is taken up where it stopped."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_current(log: DataFrame, table: str, checkpoint: str, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", every: int = 1) -> StreamingQuery:
    """The latest record of each unit, kept as versions of a table. A batch is written as a part beside the newest version;
    the ``every``-th part is folded with those before it into the next version. So a large table is rewritten once in
    ``every`` batches, and a batch else costs what it holds. With 1 each batch makes a version, and sinks.current reads
    all; with more, ``kept`` does. Taking a batch in twice changes nothing, so it may be repeated."""
    order = [F.col(time), F.col(tie)]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if every > 1:
            sinks.add_part(lg.latest(batch, [unit], order), table, number)
            if sinks.parts(spark, table) < every:
                return
            rows = sinks.with_parts(spark, table)
        else:
            rows = sinks.current(spark, table).unionByName(batch) if sinks.exists(spark, table) else batch
        sinks.replace(lg.latest(rows, [unit], order), table)

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, table: str, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id") -> DataFrame:
    """What keep_current keeps: the latest record of each unit in the newest version and the parts since."""
    return lg.latest(sinks.with_parts(spark, table), [unit], [F.col(time), F.col(tie)])
