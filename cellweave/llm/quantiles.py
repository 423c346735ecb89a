"""Percentiles of very large numeric columns by radix selection, from mergeable digit histograms.

A value becomes a 64-bit integer in the same order. Round after round its next 16-bit digit is counted per group and column, below the
digits chosen so far only, and for every target rank the digit that holds it is followed. Counts of digits add up, so histograms of
separate parts (labels_dir, t, days) are summed first and give what the whole table gives. After `digits` rounds a value is known
to its upper 16*digits bits; with 4 it is exact, with fewer the answer carries the ranks that it may have.

Parts whose rows are gone are combined from summaries: the exact values at evenly spaced ranks of each part (by the same selection), each
standing for the values since the one before. Merged summaries give every percentile to within the chosen share of all ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import Stored, small_side

#: Percentiles of problem 1.
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
DIGIT = 16


@F.pandas_udf(T.LongType())
def order_key(x: pd.Series) -> pd.Series:
    """Doubles as integers in the same order, as unsigned bits kept in a BIGINT; NULL and NaN give NULL, -0.0 is 0.0."""
    v = x.to_numpy(np.float64, copy=True) + 0.0
    bits = v.view(np.int64)
    keys = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63)))
    return pd.Series(keys).astype("Int64").mask(np.isnan(v))


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double of an order key."""
    keys = k.to_numpy(np.int64)
    v = np.where(keys < 0, keys ^ np.int64(-(2**63)), ~keys).view(np.float64)
    # the lower end of the digit that holds -inf lies among the NaNs
    return pd.Series(np.where(np.isnan(v), -np.inf, v))


def keyed(df: DataFrame, group: str, columns: Sequence[str], part: str | None = None) -> DataFrame:
    """(grp, part, col, key): a row for each value; rows without value are left out."""
    part_col = F.lit(None).cast("string") if part is None else F.col(part).cast("string")
    flat = df.select(F.col(group).alias("grp"), part_col.alias("part"), *[order_key(F.col(c).cast("double")).alias(f"k{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"k{i}").alias("key")) for i in range(len(columns))]))
    return flat.select("grp", "part", pairs.alias("x")).select("grp", "part", "x.col", "x.key").where("key IS NOT NULL")


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("key", 64 - DIGIT * (level + 1)).bitwiseAND((1 << DIGIT) - 1).cast("int")


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("key", 64 - DIGIT * level) if level else F.lit(0).cast("bigint")


def digit_counts(keys: DataFrame, level: int, chosen: DataFrame | None = None) -> DataFrame:
    """(grp, part, col, prefix, digit, n): a mergeable histogram of the level's digit, below the chosen prefixes if any.

    Sums over parts, days or tables are histograms again. At most 65,536 digits a group, column and prefix; map tasks add up first.
    """
    rows = keys.select("grp", "part", "col", _prefix(level).alias("prefix"), _digit(level).alias("digit"))
    if chosen is not None:
        wanted = chosen.select(F.col("grp").alias("g"), F.col("col").alias("c"), F.col("prefix").alias("p")).distinct()
        on = F.col("grp").eqNullSafe(F.col("g")) & (F.col("col") == F.col("c")) & (F.col("prefix") == F.col("p"))
        rows = rows.join(small_side(Stored(wanted).df), on, "left_semi")
    return rows.groupBy("grp", "part", "col", "prefix", "digit").agg(F.count("*").alias("n"))


def merged(histograms: DataFrame) -> DataFrame:
    """Histograms of the same level, of any parts, as one."""
    return histograms.groupBy("grp", "col", "prefix", "digit").agg(F.sum("n").alias("n"))


def follow(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (grp, col, pct, prefix, rank) moved into the digit that holds their rank: prefix grows, rank counts from its start."""
    below = Window.partitionBy("grp", "col", "prefix").orderBy("digit")
    cum = histogram.withColumn("upto", F.sum("n").over(below))
    t = targets.select(F.col("grp").alias("g"), F.col("col").alias("c"), F.col("prefix").alias("p"), "pct", "rank", "total", "passed")
    on = F.col("grp").eqNullSafe(F.col("g")) & (F.col("col") == F.col("c")) & (F.col("prefix") == F.col("p"))
    hit = cum.join(t, on).where("rank <= upto AND rank > upto - n")
    deeper = (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix")
    start = F.col("upto") - F.col("n")
    return hit.select("grp", "col", "pct", deeper, (F.col("rank") - start).alias("rank"), "total", (F.col("passed") + start).alias("passed"), F.col("n").alias("inside"))


def first_targets(histogram: DataFrame, percents: Sequence[float]) -> DataFrame:
    """The rank of percentile p of n values is ceil(n*p/100), 1 at least."""
    totals = histogram.groupBy("grp", "col").agg(F.sum("n").alias("total"))
    exact = [Fraction(str(p)) / 100 for p in percents]
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("pct"), F.greatest(F.lit(1), F.floor((F.col("total") * q.numerator + (q.denominator - 1)) / F.lit(q.denominator))).cast("bigint").alias("rank")) for p, q in zip(percents, exact)])
    return totals.select("grp", "col", F.explode(ranks).alias("x"), "total").select("grp", "col", "x.pct", F.lit(0).cast("bigint").alias("prefix"), "x.rank", "total", F.lit(0).cast("bigint").alias("passed"))


def radix_quantiles(df: DataFrame, group: str, columns: Sequence[str], percents: Sequence[float] = PERCENTS, part: str | None = None, digits: int = 4) -> DataFrame:
    """(group, column_name, pct, value, rank, rank_error, n): percentiles of the columns per group.

    NULL and NaN are no values, infinities are; a NULL group is a group of its own; a group without values has no rows. `value` is the
    least value whose rank reaches ceil(n*pct/100); `rank` is that rank. With digits=4 the value is exact and rank_error 0;
    with fewer, `value` is the least number in the digit reached, and rank_error the number of values in it less one.
    With `part`, histograms are made per part and merged, with the same result.
    """
    keys = Stored(keyed(df, group, columns, part)).df
    targets = None
    for level in range(digits):
        counted = Stored(merged(digit_counts(keys, level, targets))).df
        targets = Stored(follow(counted, targets if targets is not None else first_targets(counted, percents))).df
    shift = 64 - DIGIT * digits
    value = key_value(F.shiftleft("prefix", shift) if shift else F.col("prefix"))
    names = F.array(*[F.lit(c) for c in columns])
    error = F.when(F.lit(digits == 4), F.lit(0)).otherwise(F.col("inside") - 1).cast("bigint")
    return targets.select(F.col("grp").alias(group), names[F.col("col")].alias("column_name"), "pct", value.alias("value"), (F.col("passed") + F.col("rank")).alias("rank"), error.alias("rank_error"), F.col("total").alias("n"))


SUMMARY = "grp STRING, part STRING, column_name STRING, value DOUBLE, weight BIGINT"


def summarise(df: DataFrame, group: str, columns: Sequence[str], part: str, error: float = 0.002) -> DataFrame:
    """(grp, part, column_name, value, weight): what to keep of each part (a day, a delivery), at most 1/error + 1 values for each group, part
    and column. `value` is an exact order statistic, `weight` the number of values after the one before it up to it. Summaries of different
    parts are simply put together; NULL and NaN are no values, a NULL group or part is one of its own."""
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    # the least value has rank 1 whatever the size
    percents = [100 * k * error for k in range(int(1 / error) + 1)] + [100.0]
    both = df.withColumn("_cw_both", F.struct(F.col(group).cast("string").alias("g"), F.col(part).cast("string").alias("p")))
    values = radix_quantiles(both, "_cw_both", columns, sorted({round(min(p, 100.0), 9) for p in percents}))
    once = values.groupBy("_cw_both", "column_name", "value").agg(F.max("rank").alias("rank"))
    before = F.lag("rank", 1, 0).over(Window.partitionBy("_cw_both", "column_name").orderBy("rank"))
    return once.select(F.col("_cw_both.g").alias("grp"), F.col("_cw_both.p").alias("part"), "column_name", "value", (F.col("rank") - before).cast("bigint").alias("weight"))


def merged_quantiles(summaries: DataFrame, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """(grp, column_name, pct, value, n) from summaries of any parts, without their rows. The true rank of `value` is its rank in the merged
    summaries or more, by less than `error` of all values and one for each part."""
    rows = summaries.groupBy("grp", "column_name", "value").agg(F.sum("weight").alias("w"))
    # at most 1/error values for each part
    each = Window.partitionBy("grp", "column_name")
    cum = rows.withColumn("upto", F.sum("w").over(each.orderBy("value"))).withColumn("n", F.sum("w").over(each))
    exact = [Fraction(str(p)) / 100 for p in percents]
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("pct"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q.numerator) / F.lit(q.denominator))).alias("rank")) for p, q in zip(percents, exact)])
    hit = cum.withColumn("x", F.explode(ranks)).where("upto >= x.rank AND upto - w < x.rank")
    return hit.select("grp", "column_name", "x.pct", "value", "n")
