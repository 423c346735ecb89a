"""Lineage tables: cycles, generations, branches and paths, cycle metrics, consistency of lengths, plot tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import hierarchy
from cellweave.schemas import value
from cellweave.session import Stored

KEY = ["dataset_id", "track_id"]


def track_rows(tracks: DataFrame) -> DataFrame:
    """Each row of a track and frame once, whenever it was loaded; NaN as NULL. Rows without dataset, track or frame are left out."""
    names = ["dataset_id", "track_id", "t", "label", "x", "y", "area", "axis_len"]
    doubles = {"x", "y", "area", "axis_len"}
    rows = tracks.select(*[(value(c) if c in doubles else F.col(c)).alias(c) for c in names]).dropna(subset=["dataset_id", "track_id", "t"])
    return rows.distinct()


def division_rows(divisions: DataFrame) -> DataFrame:
    """One division per mother, the earliest, then the one of least daughters; mothers below 1 don't count."""
    rows = divisions.where("dataset_id IS NOT NULL AND mother_track_id >= 1").groupBy("dataset_id", "mother_track_id")
    first = F.min(F.struct("t_div", "d1_track_id", "d2_track_id")).alias("d")
    return rows.agg(first).select("dataset_id", F.col("d.t_div").alias("t_div"), "mother_track_id", F.col("d.d1_track_id").alias("d1_track_id"), F.col("d.d2_track_id").alias("d2_track_id"))


def links(divisions: DataFrame) -> DataFrame:
    """(dataset_id, parent, child) of the divisions; ids below 1 don't count."""
    both = divisions.select("dataset_id", F.col("mother_track_id").alias("parent"), F.explode(F.array("d1_track_id", "d2_track_id")).alias("child"))
    return both.where("parent >= 1 AND child >= 1").distinct()


def spans(tracks: DataFrame) -> DataFrame:
    """Per track: first and last frame, observed frames and what stood at either end."""
    at = F.struct("label", "x", "y", "axis_len")
    agg = tracks.groupBy(*KEY).agg(F.min("t").alias("birth_t"), F.max("t").alias("end_t"), F.countDistinct("t").alias("n_frames"), F.min_by(at, F.struct("t", "label")).alias("first"), F.max_by(at, F.struct("t", "label")).alias("last"))
    return agg.withColumn("n_gap_frames", F.col("end_t") - F.col("birth_t") + 1 - F.col("n_frames"))


def cycles(tracks: DataFrame, divisions: DataFrame, exited: DataFrame) -> DataFrame:
    """The cycle table from track rows, division rows and the tracks (dataset_id, track_id) that left.

    parent_id is the least mother; a track without one is a root of generation 0; generation is NULL above which the mothers run in a
    circle. A track ends as divided, else exited, else censored.
    """
    s = spans(tracks).drop("first", "last")
    e = links(divisions)
    parent = e.groupBy("dataset_id", F.col("child").alias("track_id")).agg(F.min("parent").alias("parent_id"))
    mothers = divisions.select("dataset_id", F.col("mother_track_id").alias("track_id")).distinct().withColumn("divided", F.lit(True))
    left = exited.select(*KEY).where("track_id >= 0").distinct().withColumn("exited", F.lit(True))
    depth = hierarchy.depths(e).select("dataset_id", F.col("node").cast("int").alias("track_id"), F.col("depth").alias("_depth"), F.lit(True).alias("_known"))
    c = s.join(parent, KEY, "left").join(mothers, KEY, "left").join(left, KEY, "left").join(depth, KEY, "left")
    observed = F.col("parent_id").isNotNull()
    cause = F.when(F.col("divided"), "divided").when(F.col("exited"), "exited").otherwise("censored")
    c = c.withColumn("generation", F.when(F.col("_known"), F.col("_depth")).otherwise(0)).withColumn("birth_observed", observed).withColumn("end_cause", cause)
    complete = F.col("birth_observed") & (F.col("end_cause") == "divided") & (F.col("n_gap_frames") == 0)
    return c.select(*KEY, "parent_id", "generation", "birth_t", "end_t", "n_frames", "n_gap_frames", "birth_observed", "end_cause", complete.alias("complete_cycle"))


def roots(tracks: DataFrame, divisions: DataFrame) -> DataFrame:
    """Tracks that are no division's daughter."""
    return tracks.select(*KEY).distinct().join(links(divisions).select("dataset_id", F.col("child").alias("track_id")), KEY, "left_anti")


def leaves(tracks: DataFrame, divisions: DataFrame) -> DataFrame:
    """Tracks that are no division's mother."""
    return tracks.select(*KEY).distinct().join(divisions.select("dataset_id", F.col("mother_track_id").alias("track_id")), KEY, "left_anti")


def descendants_of(links_: DataFrame, wanted: DataFrame, inclusive: bool = True) -> DataFrame:
    """(dataset_id, track_id, descendant) of the wanted tracks over the links; inclusive adds the track itself, where the links know it."""
    nodes = wanted.select("dataset_id", F.col("track_id").cast("bigint").alias("node")).distinct()
    found = hierarchy.descendants(links_, nodes).where("node <> descendant")
    if inclusive:
        known = links_.select("dataset_id", F.explode(F.array("parent", "child")).cast("bigint").alias("node")).distinct()
        found = found.unionByName(nodes.join(known, ["dataset_id", "node"], "left_semi").withColumn("descendant", F.col("node")))
    return found.withColumnRenamed("node", "track_id")


def ancestors_of(tree: DataFrame, wanted: DataFrame, inclusive: bool = False) -> DataFrame:
    """(dataset_id, track_id, ancestor) along the least mothers, from `hierarchy.paths`; a track without a root has none."""
    hit = tree.withColumnRenamed("node", "track_id").join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    return hit.select(*KEY, F.explode("path").alias("ancestor")).where(F.lit(inclusive) | (F.col("ancestor") != F.col("track_id")))


def path_between(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(dataset_id, a, b) plus path, from the elder to the younger; empty if neither descends from the other."""
    p = tree.select("dataset_id", F.col("node"), "path")
    down = pairs.join(p.withColumnRenamed("node", "b").withColumnRenamed("path", "pb"), ["dataset_id", "b"], "left").join(p.withColumnRenamed("node", "a").withColumnRenamed("path", "pa"), ["dataset_id", "a"], "left")

    def cut(path: Column, of: Column) -> Column:
        at = F.array_position(path, of).cast("int")
        return F.when(at > 0, F.slice(path, at, F.size(path)))

    return down.select("dataset_id", "a", "b", F.coalesce(cut(F.col("pb"), F.col("a")), cut(F.col("pa"), F.col("b")), F.array().cast("array<bigint>")).alias("path"))


def mother_branch(tracks: DataFrame, divisions: DataFrame, open_ends: DataFrame, follow: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(dataset_id, track_id, step): from the track at the closed end of the first frame, always on to the daughter at the closed end.

    open_ends: (dataset_id, open_end); `high` follows the lesser birth position, anything else the greater; a daughter without rows
    gives the first daughter. `follow(open_end, d1, d2)` gives another choice, of structs (id, y).
    """
    s = spans(tracks)
    ends = open_ends.select("dataset_id", "open_end")
    born = s.select(*KEY, "birth_t", F.col("first.y").alias("y"))
    earliest = born.join(born.groupBy("dataset_id").agg(F.min("birth_t").alias("birth_t")), ["dataset_id", "birth_t"]).join(ends, "dataset_id", "left")
    high = F.coalesce(F.col("open_end") == "high", F.lit(False))
    order = F.struct(F.when(high, F.col("y")).otherwise(-F.col("y")), "track_id")
    start = earliest.groupBy("dataset_id").agg(F.min_by("track_id", order).alias("track_id"))
    y = born.select("dataset_id", "track_id", "y")
    d = divisions.join(ends, "dataset_id", "left")
    for k in ("d1", "d2"):
        d = d.join(y.withColumnRenamed("track_id", f"{k}_track_id").withColumnRenamed("y", f"_{k}"), ["dataset_id", f"{k}_track_id"], "left")
    if follow is None:
        second = F.when(high, F.col("_d2") < F.col("_d1")).otherwise(F.col("_d2") > F.col("_d1"))
        chosen = F.when(F.coalesce(second, F.lit(False)), F.col("d2_track_id")).otherwise(F.col("d1_track_id"))
    else:
        chosen = follow(F.col("open_end"), F.struct(F.col("d1_track_id").alias("id"), F.col("_d1").alias("y")), F.struct(F.col("d2_track_id").alias("id"), F.col("_d2").alias("y")))
    steps = d.select("dataset_id", F.col("mother_track_id").alias("parent"), chosen.alias("child")).where("child >= 1")
    tree = hierarchy.paths(steps).where("root IS NOT NULL")
    base = start.select("dataset_id", F.col("track_id").cast("bigint").alias("_start"))
    below = tree.join(base, "dataset_id").withColumn("_at", F.array_position("path", F.col("_start"))).where("_at > 0 AND node <> _start")
    members = below.select("dataset_id", F.col("node").alias("track_id"), (F.col("depth") + 1 - F.col("_at")).alias("step"))
    out = base.select("dataset_id", F.col("_start").alias("track_id"), F.lit(0).alias("step")).unionByName(members)
    return out.select("dataset_id", F.col("track_id").cast("int").alias("track_id"), F.col("step").cast("int").alias("step"))


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def intersection_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def difference_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).subtract(b.select(*KEY))


def intervals(manifest: DataFrame) -> DataFrame:
    """(dataset_id, frame_interval_min, open_end) of each dataset of a manifest, blanks as NULL, rows that stand twice once."""
    end = F.nullif(F.trim("open_end"), F.lit(""))
    return manifest.where("dataset_id IS NOT NULL").groupBy("dataset_id").agg(F.min(value("frame_interval_min")).alias("frame_interval_min"), F.min(end).alias("open_end"))


_METRICS: dict[str, Callable[[Column, str], list[Column]]] = {}


def cycle_metric(name: str) -> Callable:
    """Registers a metric: a function of frame interval and length column to aggregate columns over a track's rows."""

    def add(f: Callable[[Column, str], list[Column]]) -> Callable[[Column, str], list[Column]]:
        _METRICS[name] = f
        return f

    return add


@cycle_metric("cycle_time")
def _cycle_time(interval: Column, length: str) -> list[Column]:
    return [((F.max("t") - F.min("t") + 1) * F.coalesce(F.max(interval), F.lit(1.0))).alias("cycle_time")]


@cycle_metric("birth_length")
def _birth_length(interval: Column, length: str) -> list[Column]:
    return [F.min_by(F.col(length), F.col("t")).alias("birth_length")]


@cycle_metric("added_length")
def _added_length(interval: Column, length: str) -> list[Column]:
    return [(F.max_by(F.col(length), F.col("t")) - F.min_by(F.col(length), F.col("t"))).alias("added_length")]


@cycle_metric("growth_rate")
def _growth_rate(interval: Column, length: str) -> list[Column]:
    y = F.when(F.col(length) > 0, F.log(length))
    x = F.when(y.isNotNull(), F.col("t") * F.coalesce(interval, F.lit(1.0)))
    n = F.count(y)
    slope = F.when(n >= 2, F.regr_slope(y, x))
    r2 = F.when((n >= 2) & (F.var_pop(y) > 0), F.regr_r2(y, x))
    return [slope.alias("growth_rate"), r2.alias("growth_rate_r2"), n.alias("growth_rate_n")]


def metrics(tracks: DataFrame, manifest_intervals: DataFrame, names: Sequence[str] = ("cycle_time", "birth_length", "added_length", "growth_rate"), length: str = "axis_len") -> DataFrame:
    """The metrics of every track, in minutes where the dataset has an interval and in frames otherwise."""
    unknown = [n for n in names if n not in _METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    rows = tracks.join(manifest_intervals.select("dataset_id", "frame_interval_min"), "dataset_id", "left")
    return rows.groupBy(*KEY).agg(*[c for n in names for c in _METRICS[n](F.col("frame_interval_min"), length)])


def length_flags(tracks: DataFrame, divisions: DataFrame, tau: float = 0.3, at_open_end: DataFrame | None = None) -> DataFrame:
    """Drops of tau or more within a track from one frame to the next, and divisions whose larger daughter dropped by less. at_open_end(dataset_id, t,
    label): cells that touch the open end; flags that compare such a cell are left out, since a cell that leaves shrinks."""
    own = Window.partitionBy(*KEY).orderBy("t", "label")
    nxt = F.lead(F.struct("t", "label", "axis_len")).over(own)
    drop = 1 - F.col("n.axis_len") / F.col("axis_len")
    none = F.lit(None).cast("int")
    steps = tracks.withColumn("n", nxt).where((F.col("n.t") == F.col("t") + 1) & (F.col("axis_len") > 0)).withColumn("drop_frac", drop).where(F.col("drop_frac") >= tau)
    within = steps.select(
        "dataset_id", F.lit("drop_without_division").alias("kind"), "t", F.col("n.t").alias("t_next"), F.col("track_id").alias("src_track_id"), F.col("label").alias("src_label"),
        F.col("track_id").alias("dst1_track_id"), F.col("n.label").alias("dst1_label"), none.alias("dst2_track_id"), none.alias("dst2_label"), F.col("axis_len").alias("length_before"),
        F.col("n.axis_len").alias("length_after"), "drop_frac",
    )
    s = Stored(spans(tracks)).df
    d = divisions.join(s.select("dataset_id", F.col("track_id").alias("mother_track_id"), F.col("last").alias("m")), ["dataset_id", "mother_track_id"])
    for k in ("d1", "d2"):
        d = d.join(s.select("dataset_id", F.col("track_id").alias(f"{k}_track_id"), F.col("first").alias(k), F.col("birth_t").alias(f"{k}_t")), ["dataset_id", f"{k}_track_id"], "left")
    after = F.greatest(*[F.when(F.col(f"{k}.axis_len") > 0, F.col(f"{k}.axis_len")) for k in ("d1", "d2")])
    d = d.where(F.col("m.axis_len") > 0).withColumn("length_after", after).withColumn("drop_frac", 1 - F.col("length_after") / F.col("m.axis_len")).where(F.col("drop_frac") < tau)
    born = F.coalesce(F.least("d1_t", "d2_t"), F.col("t_div") + 1)
    across = d.select(
        "dataset_id", F.lit("division_without_drop").alias("kind"), F.col("t_div").alias("t"), born.alias("t_next"), F.col("mother_track_id").alias("src_track_id"), F.col("m.label").alias("src_label"),
        "d1_track_id", F.col("d1.label"), "d2_track_id", F.col("d2.label"), F.col("m.axis_len"), "length_after", "drop_frac",
    )
    flags = within.union(across)
    if at_open_end is None:
        return flags
    cells = F.array(*[F.struct(F.col(t).cast("int").alias("t"), F.col(c).alias("label")) for t, c in (("t", "src_label"), ("t_next", "dst1_label"), ("t_next", "dst2_label"))])
    numbered = Stored(flags.withColumn("_id", F.monotonically_increasing_id())).df
    seen = numbered.select("dataset_id", "_id", F.explode(cells).alias("x")).select("dataset_id", "_id", "x.*")
    out = seen.join(at_open_end.select("dataset_id", "t", "label").distinct(), ["dataset_id", "t", "label"]).select("_id").distinct()
    return numbered.join(out, "_id", "left_anti").drop("_id")


def cell_properties(runs: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Fitted shape of every cell from the sums of its runs (`tracking.mask_runs`): major and minor axis of the ellipse with the same second moments,
    orientation (radians from the rows' axis), eccentricity, centroid, area; with tracks(dataset_id, track_id, t, label, axis_len) only cells of
    tracks, with track_id and bbox_len. Pixels are unit squares, as the 1/12 in their moments says."""
    n = F.col("last") - F.col("first") + 1
    # sums over a run's columns in closed form
    c1 = (F.col("first") + F.col("last")) * n / 2
    c2 = (F.col("last") * (F.col("last") + 1) * (2 * F.col("last") + 1) - (F.col("first") - 1) * F.col("first") * (2 * F.col("first") - 1)) / 6
    r = F.col("row").cast("double")
    g = runs.groupBy("dataset_id", "t", "label").agg(F.sum(n).alias("area"), F.sum(r * n).alias("r"), F.sum(c1).alias("c"), F.sum(r * r * n).alias("rr"), F.sum(c2).alias("cc"), F.sum(r * c1).alias("rc"))
    mr, mc = F.col("r") / F.col("area"), F.col("c") / F.col("area")
    vr, vc = F.col("rr") / F.col("area") - mr * mr + 1 / 12, F.col("cc") / F.col("area") - mc * mc + 1 / 12
    cov = F.col("rc") / F.col("area") - mr * mc
    half, root = (vr + vc) / 2, F.sqrt((vr - vc) * (vr - vc) / 4 + cov * cov)
    major, minor = 4 * F.sqrt(half + root), 4 * F.sqrt(F.greatest(half - root, F.lit(0.0)))
    even = F.abs(vr - vc) < 1e-12
    angle = F.when(even, F.when(cov < 0, -math.pi / 4).otherwise(math.pi / 4)).otherwise(0.5 * F.atan2(2 * cov, vr - vc))
    eccentricity = F.when(half + root > 0, F.sqrt(F.greatest(1 - (half - root) / (half + root), F.lit(0.0)))).otherwise(0.0)
    out = g.select("dataset_id", "t", "label", major.alias("major_axis_length_px"), minor.alias("minor_axis_length_px"), angle.alias("orientation"), eccentricity.alias("eccentricity"), mr.alias("y"), mc.alias("x"), F.col("area").cast("double").alias("area"))
    if tracks is None:
        return out
    return tracks.select("dataset_id", "track_id", "t", "label", F.col("axis_len").alias("bbox_len")).join(out, ["dataset_id", "t", "label"])


def swimlanes(cycle_table: DataFrame) -> DataFrame:
    """A bar per track and the time at which its parent ends, for drawing."""
    parent = cycle_table.select("dataset_id", F.col("track_id").alias("parent_id"), F.col("end_t").alias("parent_end_t"))
    return cycle_table.select(*KEY, "parent_id", "generation", "birth_t", "end_t", "end_cause").join(parent, ["dataset_id", "parent_id"], "left")


def gap_segments(tracks: DataFrame) -> DataFrame:
    """Runs of consecutive frames of each track: (dataset_id, track_id, segment from 0, from_t, to_t, n_frames)."""
    own = Window.partitionBy(*KEY).orderBy("t")
    once = tracks.select(*KEY, "t").distinct()
    new = F.coalesce((F.col("t") - F.lag("t").over(own) > 1).cast("int"), F.lit(0))
    return once.withColumn("_new", new).withColumn("segment", F.sum("_new").over(own)).groupBy(*KEY, "segment").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n_frames"))
