"""Quality of segmentations: checks of frames and labels, comparison with a truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import Stored

FINDING = ["dataset_id", "frame", "severity", "check_name", "label_id", "metric_name", "metric_value", "threshold"]


def _finding(df: DataFrame, severity: str, check: str, metric: str, value: Column, threshold: Column, label: Column | None = None) -> DataFrame:
    label = F.lit(None).cast("int") if label is None else label
    return df.select("dataset_id", F.col("t").alias("frame"), F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), label.alias("label_id"), F.lit(metric).alias("metric_name"), value.cast("double").alias("metric_value"), threshold.cast("double").alias("threshold"))


def frame_sums(cells: DataFrame) -> DataFrame:
    """(dataset_id, t, n, area) of every frame from the dataset's first to its last, zeros for one without cells. cells: (dataset_id, t,
    label, area)."""
    have = Stored(cells.groupBy("dataset_id", "t").agg(F.count("*").alias("n"), F.sum("area").alias("area"))).df
    ends = have.groupBy("dataset_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = ends.select("dataset_id", F.explode(F.sequence("a", "b")).alias("t"))
    return spine.join(have, ["dataset_id", "t"], "left").fillna({"n": 0, "area": 0.0})


def small_labels(cells: DataFrame, least: float) -> DataFrame:
    """Labels of fewer pixels than `least`; none if it is 0 or less."""
    hit = cells.where(F.lit(least > 0) & (F.col("area") < least))
    return _finding(hit, "warning", "small_label", "area", F.col("area"), F.lit(least), F.col("label"))


def empty_frames(sums: DataFrame) -> DataFrame:
    return _finding(sums.where("n = 0"), "error", "empty_frame", "n_labels", F.col("n"), F.lit(0))


def jumps(sums: DataFrame, count: int, area: float) -> DataFrame:
    """Frames whose number of cells, or whose total area in relation to the frame before, changes by more than the limits."""
    before = sums.select("dataset_id", (F.col("t") + 1).alias("t"), F.col("n").alias("_n"), F.col("area").alias("_area"))
    both = Stored(sums.join(before, ["dataset_id", "t"])).df
    step = F.col("n") - F.col("_n")
    share = (F.col("area") - F.col("_area")) / F.greatest("_area", F.lit(1.0))
    return _finding(both.where(F.abs(step) > count), "warning", "cell_count_jump", "count_change", step, F.lit(count)).unionByName(
        _finding(both.where(F.abs(share) > area), "warning", "total_area_jump", "area_change", share, F.lit(area))
    )


def area_outliers(cells: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Labels outside of their frame's interpolated quantiles, in frames of 3 labels and more."""
    limits = cells.groupBy("dataset_id", "t").agg(F.percentile("area", F.lit(low)).alias("lo"), F.percentile("area", F.lit(high)).alias("hi"), F.count("*").alias("n")).where("n >= 3")
    both = cells.join(limits, ["dataset_id", "t"])
    out = both.where((F.col("area") < F.col("lo")) | (F.col("area") > F.col("hi")))
    return _finding(out, "info", "area_outlier", "area", F.col("area"), F.when(F.col("area") < F.col("lo"), F.col("lo")).otherwise(F.col("hi")), F.col("label"))


def basic_checks(cells: DataFrame, least: float = 20.0, count: int = 2, area: float = 0.5) -> DataFrame:
    """All findings. cells: one row per dataset, frame and label."""
    sums = Stored(frame_sums(cells)).df
    return empty_frames(sums).unionByName(small_labels(cells, least)).unionByName(jumps(sums, count, area)).unionByName(area_outliers(cells))


def overlaps(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(dataset_id, t, pred, truth, inter, n_pred, n_truth) of labels that share pixels. Both: (dataset_id, t, r, c, label)."""
    keys = ["dataset_id", "t", "r", "c"]
    p = predicted.where("label > 0").select(*keys, F.col("label").alias("pred"))
    q = truth.where("label > 0").select(*keys, F.col("label").alias("truth"))
    inter = p.join(q, keys).groupBy("dataset_id", "t", "pred", "truth").agg(F.count("*").alias("inter"))
    return with_sizes(inter, p.groupBy("dataset_id", "t", "pred").agg(F.count("*").alias("n_pred")), q.groupBy("dataset_id", "t", "truth").agg(F.count("*").alias("n_truth")))


def with_sizes(inter: DataFrame, n_pred: DataFrame, n_truth: DataFrame) -> DataFrame:
    return inter.join(n_pred, ["dataset_id", "t", "pred"]).join(n_truth, ["dataset_id", "t", "truth"])


def splits_and_merges(table: DataFrame, share: float = 0.1) -> DataFrame:
    """Per frame: truths covered by two predictions and more, and predictions over two truths and more, each by `share` at least."""
    split = table.where(F.col("inter") >= share * F.col("n_truth")).groupBy("dataset_id", "t", "truth").agg(F.count("*").alias("k")).where("k >= 2").groupBy("dataset_id", "t").agg(F.count("*").alias("n_splits"))
    merge = table.where(F.col("inter") >= share * F.col("n_pred")).groupBy("dataset_id", "t", "pred").agg(F.count("*").alias("k")).where("k >= 2").groupBy("dataset_id", "t").agg(F.count("*").alias("n_merges"))
    frames = table.select("dataset_id", "t").distinct()
    return frames.join(split, ["dataset_id", "t"], "left").join(merge, ["dataset_id", "t"], "left").fillna(0, ["n_splits", "n_merges"])


def match_labels(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The matching of most pairs, and among those of greatest summed IoU; edges: (pred, truth, iou)."""
    preds, truths = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    n, m = len(preds), len(truths)
    size = max(n, m)
    # a pair is worth more than any sum of IoUs
    gain = np.zeros((size, size))
    for p, q, iou in edges:
        gain[preds.index(p), truths.index(q)] = size + 1 + iou
    cost = gain.max(initial=0) - gain
    # shortest augmenting paths with potentials
    u, v, owner = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    ious = {(p, q): x for p, q, x in edges}
    found = [(preds[owner[j] - 1], truths[j - 1]) for j in range(1, m + 1) if owner[j] - 1 < n]
    return sorted((p, q, ious[p, q]) for p, q in found if (p, q) in ious)


def evaluate(table: DataFrame, n_pred: DataFrame, n_truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per frame: labels on both sides, matched pairs (tp) and their mean IoU. table as `overlaps` gives it; a frame's labels are one
    task's work, many frames to a task."""
    iou = F.col("inter") / (F.col("n_pred") + F.col("n_truth") - F.col("inter"))
    edges = table.withColumn("iou", iou).where(F.col("iou") >= threshold).groupBy("dataset_id", "t").agg(F.collect_list(F.struct("pred", "truth", "iou")).alias("edges"))

    def match(batches):
        for pdf in batches:
            got = [match_labels([(e["pred"], e["truth"], e["iou"]) for e in x]) for x in pdf["edges"]]
            yield pd.DataFrame({"dataset_id": pdf["dataset_id"], "t": pdf["t"], "tp": [len(g) for g in got], "sum_iou": [sum(e[2] for e in g) for g in got]})

    matched = edges.mapInPandas(match, T.StructType([edges.schema["dataset_id"], edges.schema["t"], T.StructField("tp", T.LongType()), T.StructField("sum_iou", T.DoubleType())]))
    p = n_pred.groupBy("dataset_id", "t").agg(F.count("*").alias("n_pred"))
    q = n_truth.groupBy("dataset_id", "t").agg(F.count("*").alias("n_truth"))
    return p.join(q, ["dataset_id", "t"], "full").join(matched, ["dataset_id", "t"], "left").fillna(0)


def summary(evaluations: DataFrame) -> DataFrame:
    """Precision, recall, F1, MODSA and mean IoU over all frames; NULL where nothing is to be divided by."""
    s = evaluations.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("p"), F.sum("n_truth").alias("q"), F.sum("sum_iou").alias("iou"))
    tp, p, q = F.col("tp").cast("double"), F.col("p"), F.col("q")
    return s.select(
        F.try_divide(tp, p).alias("precision"), F.try_divide(tp, q).alias("recall"), F.try_divide(2 * tp, p + q).alias("f1"),
        F.try_divide(tp - (p - tp), q.cast("double")).alias("modsa"), F.try_divide(F.col("iou"), tp).alias("mean_iou"),
    )
