"""The log as a stream of changes: what is current for each unit is state, and a row leaves when it changes.

Of the inserts of a unit the one recorded last is current (by time, then by the tie), whatever the order in which batches
bring them. A row of the feed is an insert that became current, with ``superseded``: the record that was current before it,
null for a new unit. What comes late (an insert older than the current one) or twice changes nothing and leaves no row. So
the rows of a unit form a chain, and the last of them is the current record. Records of other kinds go through as they are,
with a null ``superseded``; a null kind is no insert and isn't passed on, as in ``log.current_events``.

Defined results: a null unit is a unit; a null time or tie is older than any other. A batch without rows changes nothing.
State is kept for buckets of units: a batch reads and writes the buckets that its units fall in.
Rows of a unit meet one after the other and one is kept, so a unit may have any number of them; before they are dealt out
by bucket, each task keeps the last of every unit, so a unit with most rows isn't most of what one task reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, FractionalType, StringType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(place: tuple) -> tuple:
    """Orders places in time, nulls first."""
    return tuple((x is not None, x) for x in place)


#: Units are dealt to so many states by their hash. Spark asks Python for every state one by one, over a socket, so a state a
#: unit would cost milliseconds a unit. States of a checkpoint keep to this number, so it stays as it is.
BUCKETS = 1 << 13
UNIT, BUCKET = "_feed_unit", "_feed_bucket"


def _name(unit: str, kind: DataType) -> Column:
    """The unit as text, equal for what a grouping takes as equal."""
    c = F.col(unit)
    if isinstance(kind, BinaryType):
        return F.hex(c)
    return (c + F.lit(0.0) if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType) else c).cast("string")


class Latest(StatefulProcessor):
    """Keeps the places (time, tie) of the current records of a bucket's units."""

    def __init__(self, schema: StructType, time: str, tie: str):
        self.names, self.time, self.tie = schema.names, time, tie
        kinds = {"unit": StringType(), "time": schema[time].dataType, "tie": schema[tie].dataType}
        self.kept = StructType([StructField(c, ArrayType(k)) for c, k in kinds.items()])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[str | None, tuple[tuple, Row]] = {}
        for r in rows:
            unit, rank = r[UNIT], _rank((r[self.time], r[self.tie]))
            if unit not in best or best[unit][0] < rank:
                best[unit] = rank, r
        before = self.current.get()
        kept = {u: (time, tie) for u, time, tie in zip(*before)} if before else {}
        found, made = [], Row(*self.names, "superseded")
        for unit, (rank, r) in best.items():
            was = kept.get(unit)
            if was is None or _rank(was) < rank:
                kept[unit] = r[self.time], r[self.tie]
                found.append(made(*(r[c] for c in self.names), was and was[1]))
        if found:
            self.current.update((list(kept), *map(list, zip(*kept.values()))))
        yield from found

    def close(self) -> None:
        pass


#: Bytes of rows that a task holds to find the last of each unit, and rows that it passes on at once.
HELD_BYTES, PASSED_ROWS = 64 << 20, 10_000


def _newest(name: str, time: str, tie: str):
    """The last row of each unit among those that come together. What is held is bounded: if its last rows alone fill half
    the room, they are passed on."""

    def last(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(held)
        order = pc.sort_indices(batch, sort_keys=[(time, "ascending"), (tie, "ascending")], null_placement="at_start").to_numpy()
        units = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()[order][::-1]
        _, first = np.unique(units, return_index=True)
        return batch.take(pa.array(order[::-1][np.sort(first)]))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        passed = lambda batch: (batch.slice(i, PASSED_ROWS) for i in range(0, batch.num_rows, PASSED_ROWS))
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                kept = last(held)
                held, size = [kept], kept.nbytes
                if size > HELD_BYTES // 2:
                    yield from passed(kept)
                    held, size = [], 0
        if held:
            yield from passed(last(held))

    return reduced


def changes(log: DataFrame, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", kind: str | None = "kind") -> DataFrame:
    """The feed of a streamed log. Without ``kind`` every record is an insert."""
    inserts = log if kind is None else log.where(F.col(kind) == "insert")
    # moments cross to Python and back as numbers, so that no time zone of a worker has a say
    moments = [f.name for f in log.schema if isinstance(f.dataType, TimestampType)]
    rows = inserts.withColumns({c: F.unix_micros(c) for c in moments})
    out = StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField("superseded", rows.schema[tie].dataType)])
    named = rows.withColumn(UNIT, _name(unit, rows.schema[unit].dataType)).withColumn(BUCKET, F.pmod(F.xxhash64(UNIT), F.lit(BUCKETS)))
    # Python takes a row at a time beside its state, so by then one row a unit is left: first of a task, then of a bucket
    fewer = lambda df: df.mapInArrow(_newest(UNIT, time, tie), named.schema)
    dealt = fewer(fewer(named).repartition(BUCKET))
    feed = dealt.groupBy(BUCKET).transformWithState(Latest(rows.schema, time, tie), out, "Append", "None").withColumns({c: F.timestamp_micros(c) for c in moments})
    if kind is None:
        return feed
    return feed.unionByName(log.where(F.col(kind) != "insert").withColumn("superseded", F.lit(None).cast(log.schema[tie].dataType)))


def follow(log: DataFrame, out: str, checkpoint: str, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", kind: str | None = "kind") -> StreamingQuery:
    """Writes the feed of all that has arrived as Parquet; a run that breaks off is taken up where it stopped. State is kept
    in RocksDB beside the checkpoint; the session's own choice for other queries stays."""
    spark = log.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return changes(log, unit, time, tie, kind).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
