"""Top N items of every group by a global sort and exact positions.

The candidates are range-partitioned by group, score and tie-breakers and sorted, so a group of any size lies over as many partitions
as it needs. Each partition numbers its distinct items per group and keeps the first N of each; the kept counts of the partitions are
prefix-summed into exact positions, of which those up to N stay.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import Stored


def _first_of_each(group: str, item: Sequence[str], n: int):
    """Arrow batches in order to their first n distinct items per group, with partition, local position and whether the group is the
    first of its partition, that is, may go on from the one before."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_group, last_item, seen, groups = None, None, 0, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            g = batch.column(group)
            items = [batch.column(c) for c in item]

            def changed(column, before):
                out = np.ones(rows, bool)
                if rows > 1:
                    a, b = column.slice(1), column.slice(0, rows - 1)
                    eq = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    out[1:] = ~eq.to_numpy(zero_copy_only=False)
                out[0] = before is None or before[0] != column[0].as_py()
                return out

            new_group = changed(g, last_group)
            new_item = new_group.copy()
            for k, column in enumerate(items):
                new_item |= changed(column, None if last_item is None else (last_item[k],))
            count = np.cumsum(new_item)
            start = np.where(new_group, count - 1, 0)
            # before the first new group the count goes on from the batch before
            start = np.maximum.accumulate(start)
            local = count - start
            first = np.flatnonzero(new_group)
            head = first[0] if len(first) else rows
            local[:head] += seen
            keep = new_item & (local <= n)
            # the first group is new in the first row of the partition only
            number = np.cumsum(new_group) + groups
            groups = int(number[-1])
            seen, last_group, last_item = int(local[-1]), (g[rows - 1].as_py(),), [c[rows - 1].as_py() for c in items]
            if keep.any():
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(kept.num_rows, pid), pa.int32()), pa.array(local[keep], pa.int64()), pa.array(number[keep] == 1)], names=[*kept.schema.names, "_pid", "_local", "_first"])

    return run


def top_n(df: DataFrame, group: str, item: Sequence[str], order: Sequence[Column], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """(group, *item, *keep, position): the first n distinct items of each group by `order`, positions from 1.

    Rows with a NULL group take no part. Rows that agree in group and item are one item if they agree in `order` as well (copies);
    `order` must end with `item`, so that ties are settled. Groups with fewer items keep them all; an empty table gives no rows.
    """
    columns = list(dict.fromkeys([group, *item, *keep]))
    rows = df.where(F.col(group).isNotNull())
    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).select(*columns)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_first", T.BooleanType())])
    kept = Stored(ordered.mapInArrow(_first_of_each(group, list(item), n), schema)).df
    # only a partition's first group can have begun before it: a group per partition at most, which is what makes these tables small
    going_on = F.broadcast(kept.where("_first").select(group).distinct())
    counts = kept.join(going_on, group, "left_semi").groupBy(group, "_pid").agg(F.max("_local").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), F.sum("_n").over(earlier).alias("_before"))
    placed = kept.join(F.broadcast(before), (F.col(group) == F.col("_g")) & (F.col("_pid") == F.col("_p")), "left")
    position = F.col("_local") + F.coalesce("_before", F.lit(0))
    return placed.withColumn("position", position).where(F.col("position") <= n).select(*columns, "position")


def top_candidates(scored: DataFrame, n: int = 3) -> DataFrame:
    """(pair_id, sample_rank, position) of the n best candidates of each pair: raw_score descending, dp_cost ascending with NULL
    last, sample_rank ascending. Rows whose raw_score is NULL, NaN or infinite and rows without pair_id take no part."""
    score = F.col("raw_score")
    usable = scored.select("pair_id", "sample_rank", "raw_score", "dp_cost").where(score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    # -0.0 and 0.0 are equal scores
    usable = usable.withColumn("raw_score", F.col("raw_score") + F.lit(0.0))
    return top_n(usable, "pair_id", ["sample_rank"], [score.desc(), F.col("dp_cost").asc_nulls_last(), F.col("sample_rank").asc()], n)
