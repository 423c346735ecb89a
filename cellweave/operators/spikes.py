"""Implausible readings per source: impossible values, values far from the source's normal course, stuck values.

Every reading of a source is a series of its own (drop_frac and the length after per kind too), in the order of exact positions. What a
series is like is summed up over the whole source: how much two and three neighbours differ gives the variances of a random walk plus noise,
how often neighbours are equal gives the run that chance explains. With these, a Kalman filter forecasts each value, once forwards and once
backwards. A reading is far off if its standardised innovation is above the threshold in both directions, and such an update is withheld. It is
stuck if the innovations of the filter without measurement noise have no variance over a window that chance doesn't fill.

All passes run over short blocks of a series, each with a margin from its neighbours in which the filter settles, all blocks of a batch at
once: one numpy step per place. Estimates belong to the source, so where the blocks begin makes no difference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.positions import with_positions
from cellweave.session import Stored, small_side

#: Values of a block, and values it sees of either neighbour.
BLOCK, MARGIN = 512, 128
#: Values that one batch of blocks holds, about.
BATCH = 64_000
#: Neighbouring blocks that go into one batch, so that what they tell of their series is added up there.
TOGETHER = 32
#: Standardised innovation from which a reading is far off.
THRESHOLD = 6.0
#: Bounds of the share of the innovation that a settled filter takes up.
GAINS = (0.15, 0.3)
#: A run of equal values is stuck from this length, or the length of which chance would bring less than CHANCE in its source.
LEAST_RUN, CHANCE = 6, 0.1
#: Withheld updates in a row after which the source itself has moved.
PATIENCE = 25
#: Differences are counted in so many bins per power of e; within a bin their median is interpolated.
BINS = 16


def impossible(before: Column, after: Column, drop: Column) -> Column:
    """True of readings that no cell can have had; NULL is no case."""
    def broken(c: Column) -> Column:
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))

    expected = F.lit(1.0) - F.try_divide(after, before)
    off = F.abs(drop - expected) > F.lit(0.01) + F.abs(expected) * 1e-3
    bad = broken(before) | broken(after) | broken(drop)
    bad = bad | F.coalesce(before <= 0, F.lit(False)) | F.coalesce(after <= 0, F.lit(False)) | F.coalesce(drop > 1, F.lit(False))
    return bad | F.coalesce(off, F.lit(False))


def filter_blocks(x: np.ndarray, usable: np.ndarray, r: np.ndarray, q: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Standardised one-step innovations of series in columns, forwards: a random walk of variance q plus noise of variance r, both per
    column. NaN has none; what isn't usable is forecast over, not taken up. A column with fewer than 5 usable values has none."""
    steps, n = x.shape
    usable = usable & ~np.isnan(x)
    level = np.full(n, np.nan)
    for k in range(n):
        head = x[usable[:, k], k][:31]
        if len(head) >= 5:
            level[k] = np.median(head)
    p = r.copy()
    refused = np.zeros(n, np.int32)
    out = np.full(x.shape, np.nan)
    with np.errstate(all="ignore"):
        for i in range(steps):
            v, ok = x[i], usable[i]
            p = p + q
            s = p + r
            innovation = v - level
            z = innovation / np.sqrt(s)
            out[i] = z
            near = ok & (np.abs(z) < threshold)
            far = ok & ~near & ~np.isnan(z)
            k = np.where(near, p / s, 0.0)
            level = level + np.where(near, k * innovation, 0.0)
            refused = np.where(near, 0, refused + far)
            # widen until the source is found again
            p = p * (1 - k) + np.where(far & (refused > PATIENCE), 4 * r, 0.0)
    return out


def far_off(x: np.ndarray, usable: np.ndarray, r: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Flags of values whose innovation is above the threshold in both directions."""
    f = np.abs(filter_blocks(x, usable, r, q, threshold))
    b = np.abs(filter_blocks(x[::-1], usable[::-1], r, q, threshold)[::-1])
    return np.where(np.isnan(f) | np.isnan(b), False, np.fmin(f, b) > threshold)


def still_runs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each value the number of values in the run around it over which the innovations of a filter without measurement noise, which
    forecasts the value before, have no variance; 1 if there is none, 0 for NaN. first: where another block begins."""
    innovation = np.r_[np.nan, np.diff(x)]
    innovation[first] = np.nan
    with np.errstate(all="ignore"):
        moved = ~(np.square(innovation) <= np.square(1e-12 * x))
    run = np.cumsum(moved) - 1
    return np.where(np.isnan(x), 0, np.bincount(run)[run]) if len(x) else np.zeros(0, np.int64)


def windows(rows: Column, equal: Column, normal: Column) -> Column:
    """The least run that is stuck in a source of so many rows, of which `normal` are in short runs and `equal` of these repeat their neighbour."""
    p = equal / F.greatest(normal, F.lit(1))
    # rows * p ** (run - 1) <= CHANCE
    chance = F.ceil(F.log(F.lit(CHANCE) / F.greatest(rows, F.lit(1))) / F.log(p)) + 1
    return F.greatest(F.lit(LEAST_RUN), F.when((p > 0) & (p < 1), chance).otherwise(LEAST_RUN))


def variances(rows: Column, one: Column, two: Column, level: Column, gains: tuple[float, float] = GAINS) -> tuple[Column, Column]:
    """(r, q): noise and walk of a series from the median differences of neighbours, one and two places apart. A walk adds q per place
    and noise 2r to the square of either; the filter's settled gain is kept within bounds. Of less than 200 values the least gain is taken."""
    noise = F.greatest(1.4826 * one / 2**0.5, 1e-3 * F.greatest(F.abs(level), F.lit(1e-3)), F.lit(1e-6))
    r = noise * noise
    walk = (1.4826**2) * (two * two - one * one)
    low, high = (g * g / (1 - g) for g in gains)
    ratio = F.when(rows >= 200, F.least(F.greatest(walk / r, F.lit(low)), F.lit(high))).otherwise(F.lit(low))
    return r, r * ratio


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.log(np.where(np.isfinite(x) & (x > 0), x, np.nan))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


class Batch:
    """Rows of many blocks in order, and where each lies in a matrix with a block per column."""

    def __init__(self, pdf: pd.DataFrame):
        at = np.lexsort([pdf[c].to_numpy() for c in ("pos", "block", "sid")])
        self.columns = {c: pdf[c].to_numpy()[at] for c in pdf.columns if c not in ("batch", "kinds")}
        sid, block = self.columns["sid"], self.columns["block"]
        new = np.r_[True, (sid[1:] != sid[:-1]) | (block[1:] != block[:-1])]
        self.first = np.flatnonzero(new)
        self.column = np.cumsum(new) - 1
        self.place = np.arange(len(sid)) - self.first[self.column]
        self.own, self.bad = self.columns["own"].astype(bool), self.columns["bad"].astype(bool)
        self.sid = sid

    def column_of(self, name: str) -> np.ndarray:
        return self.columns[name].astype(float)

    def matrix(self, x: np.ndarray, fill: float | bool) -> np.ndarray:
        out = np.full((self.place.max() + 1, len(self.first)), fill)
        out[self.place, self.column] = x
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of x over each block."""
        return np.add.reduceat(x, self.first)

    def series(self, kinds: bool) -> dict[str, np.ndarray]:
        after = _log(self.column_of("length_after"))
        return {"after": after, "drop": _finite(self.column_of("drop_frac"))} if kinds else {"before": _log(self.column_of("length_before"))}


#: Rows that a pass over the blocks gives: facts of a series, or values in still runs.
FACTS = "sid BIGINT, series STRING, what STRING, lag INT, bin BIGINT, n BIGINT, total DOUBLE, row BIGINT, t INT, src_track_id INT"
_NONE = -(1 << 20)


def _measure(kinds: bool):
    """What blocks tell of their series: sizes and sums, differences of neighbours in bins; without kinds also runs of equal lengths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Batch(pdf)
        out = []
        held = np.zeros(len(b.sid), bool)
        sid = b.sid[b.first]
        for c in () if kinds else ("length_before", "length_after"):
            x = _finite(b.column_of(c))
            length = still_runs(x, b.first)
            same = np.r_[False, x[1:] == x[:-1]]
            same[b.first] = False
            normal = b.own & (length < LEAST_RUN)
            for what, mask in (("rows", b.own), ("normal", normal), ("equal", normal & same)):
                out.append(pd.DataFrame({"sid": sid, "series": c, "what": what, "n": b.sums(mask.astype(np.int64))}))
            hit = b.own & (length >= LEAST_RUN)
            held |= length >= LEAST_RUN
            out.append(pd.DataFrame({"sid": b.sid[hit], "series": c, "what": "run", "n": length[hit], **{k: b.columns[k][hit] for k in ("row", "t", "src_track_id")}}))
        for name, x in b.series(kinds).items():
            good = ~(np.isnan(x) | b.bad | held)
            own = good & b.own
            out.append(pd.DataFrame({"sid": sid, "series": name, "what": "sum", "n": b.sums(own.astype(np.int64)), "total": b.sums(np.where(own, x, 0.0))}))
            for lag in (1, 2):
                both = np.flatnonzero(own[lag:] & good[:-lag] & (b.column[lag:] == b.column[:-lag])) + lag
                diff = np.abs(x[both] - x[both - lag])
                with np.errstate(all="ignore"):
                    bins = np.where(diff > 0, np.floor(np.log(diff) * BINS), _NONE).astype(np.int64)
                # one number for series and bin
                ids, number = np.unique(b.sid, return_inverse=True)
                code, n = np.unique(number[both] * (1 << 22) + (bins - _NONE), return_counts=True)
                out.append(pd.DataFrame({"sid": ids[code >> 22], "series": name, "what": "diff", "lag": lag, "bin": (code & ((1 << 22) - 1)) + _NONE, "n": n}))
        whole = pd.concat(out, ignore_index=True)
        for c in ("lag", "bin", "row", "t", "src_track_id"):
            whole[c] = (whole[c] if c in whole else pd.Series(pd.NA, whole.index)).astype("Int64")
        return whole[["sid", "series", "what", "lag", "bin", "n", "total", "row", "t", "src_track_id"]]

    return run


def _judge(kinds: bool, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Batch(pdf)
        usable = b.matrix(~b.bad, False)
        flag = np.zeros(len(b.sid), bool)
        for name, x in b.series(kinds).items():
            r, q = (b.column_of(f"{c}_{name}")[b.first] for c in ("r", "q"))
            flag |= far_off(b.matrix(x, np.nan), usable, r, q, threshold)[b.place, b.column]
        flag &= b.own
        return pd.DataFrame({c: b.columns[c][flag] for c in ("sid", "t", "src_track_id")})

    return run


def _in_blocks(rows: DataFrame, block: int, margin: int, batches: int) -> DataFrame:
    """rows(sid, pos, ...) with a row for each block that sees it, and the batch of that block."""
    home = F.floor(F.col("pos") / block)
    inside = F.col("pos") - home * block
    if margin < block:
        near = F.array_compact(F.array(home, F.when((inside < margin) & (home > 0), home - 1), F.when(inside >= block - margin, home + 1)))
    else:
        near = F.sequence(F.greatest(F.floor((F.col("pos") - margin) / block), F.lit(0)), F.floor((F.col("pos") + margin) / block))
    spread = rows.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == home)
    return spread.withColumn("batch", F.pmod(F.xxhash64("sid", F.floor(F.col("block") / TOGETHER)), F.lit(batches)))


def _variances(facts: DataFrame) -> DataFrame:
    """(sid, r_<series>, q_<series>) of each series, from bins that are added up over all blocks, some hundred of a series."""
    bins = facts.where("what = 'diff'").groupBy("sid", "series", "lag", "bin").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("sid", "series", "lag")
    upto = F.sum("n").over(each.orderBy("bin"))
    half = bins.withColumn("upto", upto).withColumn("half", F.sum("n").over(each) / 2).where("upto >= half AND upto - n < half")
    inside = (F.col("half") - F.col("upto") + F.col("n")) / F.col("n")
    diff = F.when(F.col("bin") > _NONE, F.exp((F.col("bin") + inside) / BINS)).otherwise(0.0)
    middle = half.groupBy("sid", "series").agg(*[F.max(F.when(F.col("lag") == k, diff)).alias(f"m{k}") for k in (1, 2)])
    sizes = facts.where("what = 'sum'").groupBy("sid", "series").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    known = sizes.join(middle, ["sid", "series"], "left").fillna(0.0, ["m1", "m2"])
    r, q = variances(F.col("n"), F.col("m1"), F.col("m2"), F.col("total") / F.greatest("n", F.lit(1)))
    wide = [F.max(F.when(F.col("series") == s, c)).alias(f"{name}_{s}") for s in ("before", "after", "drop") for name, c in (("r", r), ("q", q))]
    return known.groupBy("sid").agg(*wide)


def implausible_readings(flags: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(dataset_id, t, src_track_id) of the rows with an implausible length_before, length_after or drop_frac.

    Copies are one row. A NULL reading is no case and is skipped; rows whose dataset_id is NULL are a source of their own. Lengths are
    judged against the rows around them, drop_frac and the length after within the same kind. An empty table gives no rows.
    """
    lengths = ["length_before", "length_after", "drop_frac"]
    part = F.coalesce(F.concat(F.lit("="), "dataset_id"), F.lit("")).alias("part")
    once = flags.select(part, F.coalesce("kind", F.lit("")).alias("_kind"), "t", "src_track_id", *lengths).distinct()
    once = once.withColumn("bad", impossible(*[F.col(c) for c in lengths]))
    placed = with_positions(once, ["part"], [F.col("t"), F.col("src_track_id"), F.col("_kind")], "row")
    placed = Stored(with_positions(placed, ["part", "_kind"], [F.col("row")], "kpos")).df
    batches = max(placed.count() // BATCH, 1)
    # numbers of series: 0 and up for the kinds of a source, below 0 for its rows of all kinds
    numbered = Stored(placed.select("part", "_kind").distinct().withColumn("sid", F.monotonically_increasing_id())).df
    sources = Stored(numbered.join(numbered.groupBy("part").agg((-1 - F.min("sid")).alias("rid")), "part")).df
    coded = placed.join(small_side(sources), ["part", "_kind"])
    names = ["row", "t", "src_track_id", "bad", *lengths]
    by_row = coded.select(F.col("rid").alias("sid"), F.col("row").alias("pos"), *names)
    by_kind = coded.select("sid", F.col("kpos").alias("pos"), "rid", *names)

    def measured(rows: DataFrame, kinds: bool) -> DataFrame:
        return _in_blocks(rows, block, margin, batches).groupBy("batch").applyInPandas(_measure(kinds), FACTS)

    facts = Stored(measured(by_row, False).unionByName(measured(by_kind.drop("rid"), True))).df
    counts = facts.where("what IN ('rows', 'normal', 'equal')").groupBy("sid", "series")
    limits = counts.agg(*[F.sum(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in ("rows", "normal", "equal")])
    limits = limits.select("sid", "series", windows(F.col("rows"), F.col("equal"), F.col("normal")).alias("least"))
    runs = facts.where("what = 'run'").join(limits, ["sid", "series"]).where("n >= least")
    held = Stored(runs.select("sid", "row", "t", "src_track_id").distinct()).df
    normal = small_side(Stored(_variances(facts)).df)
    found = [held.select("sid", "t", "src_track_id")]
    for rows, kinds, of in ((by_row, False, "sid"), (by_kind, True, "rid")):
        stuck = held.select(F.col("sid").alias(of), "row", F.lit(True).alias("_held"))
        judged = rows.join(stuck, [of, "row"], "left").withColumn("bad", F.col("bad") | F.col("_held").isNotNull()).drop("_held", "rid")
        judged = _in_blocks(judged.join(normal, "sid"), block, margin, batches)
        found.append(judged.groupBy("batch").applyInPandas(_judge(kinds, threshold), "sid BIGINT, t INT, src_track_id INT"))
    names_of = sources.select("sid", "part").union(sources.select("rid", "part")).distinct()
    named = found[0].union(found[1]).union(found[2]).join(small_side(Stored(names_of).df), "sid").select("part", "t", "src_track_id")
    out = named.union(placed.where("bad").select("part", "t", "src_track_id")).distinct()
    return out.select(F.when(F.col("part") != "", F.substring("part", 2, 1 << 30)).alias("dataset_id"), "t", "src_track_id")
