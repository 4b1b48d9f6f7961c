"""Joins to the nearest row in an order, for tables of any size on either side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.session import checkpointed


#: Rows of a right side that are sent to every task; a larger one is dealt out together with the left side.
SMALL = 100_000


def asof(left: DataFrame, right: DataFrame, on: str, at: str, forward: bool = False, small: int = SMALL) -> DataFrame:
    """left with the columns of the row of ``right`` whose ``at`` is the largest that isn't over left's ``on``; with
    ``forward`` the smallest that isn't under it. Nulls where there is none, and for a null ``on``; rows of ``right``
    without an ``at`` are never met. Of rows with equal ``at`` the last in the order of all columns is taken, with
    ``forward`` the first. The two have no column in common.

    A right side of at most ``small`` rows is counted by being fetched, sent to the tasks and searched there, without moving
    the left side. Else both sides are dealt out together by ranges of the order, so no task holds more than a range, and rows of left with
    one value may spread over several. A task fills every row with the last row of ``right`` before it in its range; what
    no row of its range precedes takes the last one of the ranges before, of which each hands on one."""
    if shared := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    known = right.where(F.col(at).isNotNull())
    kind = dict(left.select(F.col(on)).dtypes)[on], dict(right.select(F.col(at)).dtypes)[at]
    value = lambda c: c if kind[0] == kind[1] else c.cast("string" if "string" in kind else "double")
    few = known.select(value(F.col(at)).alias("_v"), F.struct(*right.columns).alias("_right")).orderBy("_v", "_right").limit(small + 1).toArrow().combine_chunks()
    if few.num_rows <= small:
        found = _searched(few, forward, right.select(F.struct(*right.columns).alias("s")).schema["s"].dataType)
        return left.withColumn("_found", found(value(F.col(on)))).select(*left.columns, *[F.col("_found")[c].alias(c) for c in right.columns])
    return _by_ranges(left, right, known, on, at, value, forward)


def _searched(few: pa.Table, forward: bool, kind):
    """An Arrow UDF from values to the nearest of a few rows in order."""
    points = _plain(few.column("_v").combine_chunks() if few.num_rows else pa.nulls(0, few.column("_v").type))
    rows = few.column("_right").combine_chunks() if few.num_rows else pa.nulls(0, few.column("_right").type)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        mine = _plain(values)
        place = np.searchsorted(points, mine, side="left") if forward else np.searchsorted(points, mine, side="right") - 1
        none = values.is_null().to_numpy(zero_copy_only=False) | (place < 0) | (place >= len(points))
        return rows.take(pa.array(np.where(none, 0, place), mask=none)) if len(rows) else pa.nulls(len(values), rows.type)

    return run


def _plain(values: pa.Array) -> np.ndarray:
    """Values in the same order as NumPy's; nulls become any value."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.array(values.fill_null("").to_pylist(), object)
    if pa.types.is_temporal(values.type):
        values = values.cast(pa.int32() if pa.types.is_date32(values.type) else pa.int64())
    return (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False)


def _by_ranges(left: DataFrame, right: DataFrame, known: DataFrame, on: str, at: str, value, forward: bool) -> DataFrame:
    mine = left.select(F.col(on).alias("_v"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_spread"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(known.select(F.struct(*right.columns).alias("s")).schema["s"].dataType).alias("_right"))
    theirs = known.select(F.col(at).alias("_v"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_spread"), F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), F.struct(*right.columns).alias("_right"))
    both = mine.withColumn("_v", value(F.col("_v"))).unionByName(theirs.withColumn("_v", value(F.col("_v"))))
    first = F.col("_v").desc_nulls_last() if forward else F.col("_v").asc_nulls_first()
    # a null value stands where nothing can precede it
    order = [F.col("_v").isNotNull().desc() if forward else F.col("_v").isNotNull(), first, F.col("_side"), F.col("_right").desc() if forward else F.col("_right"), F.col("_spread")]
    slim = both.select("_v", "_side", "_left", "_right", "_spread")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, rows, lines = batch.column(0), batch.column(2), batch.column(3)
            is_left = batch.column(1).to_numpy(zero_copy_only=False) == 1
            last = np.maximum.accumulate(np.where(is_left, -1, np.arange(len(is_left))))
            source = lines if held is None else pa.concat_arrays([held, lines])
            shift = 0 if held is None else 1
            take = np.where(last >= 0, last + shift, 0 if shift else -1)
            take = np.where(values.is_null().to_numpy(zero_copy_only=False), -1, take)
            mask = take < 0
            found = source.take(pa.array(np.maximum(take, 0), mask=mask))
            at_rows = pa.array(np.flatnonzero(is_left))
            if len(at_rows):
                n = len(at_rows)
                yield pa.RecordBatch.from_arrays([values.take(at_rows), rows.take(at_rows), found.take(at_rows), pa.array(np.full(n, me))], names=["_v", "_left", "_right", "_range"])
            if last[-1] >= 0:
                held = lines.slice(int(last[-1]), 1)
        if held is not None:  # what the range hands on
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.null()).cast(values.type), pa.nulls(1, rows.type), held, pa.array([me])], names=["_v", "_left", "_right", "_range"])

    schema = StructType([slim.schema["_v"], StructField("_left", slim.schema["_left"].dataType), StructField("_right", slim.schema["_right"].dataType), StructField("_range", LongType())])
    filled = checkpointed(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread").mapInArrow(fill, schema))
    handed = filled.groupBy("_range").agg(F.first(F.when(F.col("_left").isNull(), F.col("_right")), ignorenulls=True).alias("_own"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    carried = handed.select("_range", F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    rows = filled.where("_left IS NOT NULL").join(F.broadcast(carried), "_range")
    best = F.when(F.col("_v").isNotNull(), F.coalesce("_right", "_carried"))
    return rows.select("_left", best.alias("_right")).select("_left.*", *[F.col("_right")[c].alias(c) for c in right.columns])
