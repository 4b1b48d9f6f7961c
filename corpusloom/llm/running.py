"""Running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import stored, unused


def running(df: DataFrame, group: str, order: list[str], weight: str, into: str = "before") -> DataFrame:
    """df with a column of the sum of ``weight`` (bigint, not null) over the rows of the same group (not null) that stand
    before the row in the order, nulls first. Rows that are equal in the order follow each other in any order.

    Rows are dealt out by ranges of group and order, so that a group may be of any size; tasks add up their own range, and
    what stands before it in its group comes from a table of one row for each range and group. df is read twice."""
    part, at = unused("_range", df), unused("_at", df)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(w)
            if len(w):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), me)), pa.array(ends - w)], names=[*batch.schema.names, part, at])

    schema = StructType([*df.schema.fields, StructField(part, LongType()), StructField(at, LongType())])
    dealt = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(add_up, schema), "running")
    ranges = dealt.groupBy(group, part).agg(F.min(at).alias("_first"), F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select(group, part, (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return dealt.join(base, [group, part]).select(*df.columns, (F.col("_base") + F.col(at)).alias(into))
