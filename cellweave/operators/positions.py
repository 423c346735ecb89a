"""Exact positions and running sums in a global order, without one task per group.

The rows are sorted over range partitions. Each partition numbers (or sums) its own rows, the totals of each group in each
partition are prefix-summed, and the two together give every row's place in its group. A group may span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import Stored, small_side


def _offsets(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """totals(group, _pid, _total): with _before, the sum over the group's earlier partitions."""
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_pid", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))


def _rejoin(local: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    right = small_side(offsets.select(*[F.col(c).alias(f"_r_{c}") for c in group], F.col("_pid").alias("_r_pid"), "_before"))
    on = F.col("_pid") == F.col("_r_pid")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return local.join(right, on).drop("_r_pid", *[f"_r_{c}" for c in group])


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """df plus `out`, the row's position from 0 within its group by `order`; NULL is a group of its own. Rows that tie in
    `order` share a partition and come in any order among themselves."""
    group = list(group)
    ordered = df.repartitionByRange(*[F.col(c) for c in group], *order).sortWithinPartitions(*group, *order)
    rows = Stored(ordered.withColumn("_mid", F.monotonically_increasing_id())).df
    rows = rows.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND((1 << 33) - 1))
    parts = Stored(rows.groupBy(*group, "_pid").agg(F.min("_idx").alias("_first"), F.count("*").alias("_total"))).df
    offsets = _offsets(parts, group).join(
        parts.select(*[F.col(c).alias(f"_s_{c}") for c in group], F.col("_pid").alias("_s_pid"), "_first"),
        _same(group) & (F.col("_pid") == F.col("_s_pid")),
    )
    offsets = offsets.select(*group, "_pid", (F.col("_before") - F.col("_first")).alias("_before"))
    return _rejoin(rows, Stored(offsets).df, group).withColumn(out, F.col("_idx") + F.col("_before")).drop("_mid", "_pid", "_idx", "_before")


def _same(group: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return on


def with_running_sums(df: DataFrame, group: str, order: Sequence[Column], value: str, out: str = "before") -> DataFrame:
    """df plus `out`, the sum of the BIGINT column `value` over the earlier rows of the group, and `out`_total, the group's sum."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.LongType()), T.StructField(out, T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            key, v = pdf[group], pdf[value].fillna(0).to_numpy(np.int64)
            new = (key != key.shift()) & ~(key.isna() & key.shift().isna())
            new.iloc[0] = not (last == key.iloc[0] or (last is None and pd.isna(key.iloc[0]) and total))
            sums = np.cumsum(v) - v
            starts = np.flatnonzero(new.to_numpy())
            base = np.zeros(len(v), np.int64)
            bounds = [*starts.tolist(), len(v)]
            if not len(starts) or starts[0] > 0:
                base[: bounds[0]] = total
            for a, b in zip(bounds[:-1], bounds[1:]):
                base[a:b] = -sums[a]
            sums = sums + base
            last, total = key.iloc[-1] if not pd.isna(key.iloc[-1]) else None, int(sums[-1] + v[-1])
            yield pdf.assign(_pid=pid, **{out: sums})

    ordered = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    rows = Stored(ordered.mapInPandas(run, schema)).df
    totals = Stored(rows.groupBy(group, "_pid").agg(F.sum(value).alias("_total"))).df
    offsets = _offsets(totals, [group])
    whole = totals.groupBy(F.col(group).alias("_w")).agg(F.sum("_total").alias(f"{out}_total"))
    offsets = Stored(offsets.join(F.broadcast(whole) if whole.count() <= 10_000 else whole, F.col(group).eqNullSafe(F.col("_w"))).drop("_w")).df
    right = small_side(offsets.select(F.col(group).alias("_r"), F.col("_pid").alias("_r_pid"), "_before", f"{out}_total"))
    joined = rows.join(right, F.col(group).eqNullSafe(F.col("_r")) & (F.col("_pid") == F.col("_r_pid")))
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_r", "_r_pid", "_pid", "_before")
