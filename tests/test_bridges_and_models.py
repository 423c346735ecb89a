"""Bridges over dropped pairs, masks, shapes, detectors and stored models: brute force and hand-made fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import costs, ops
from cellweave.operators import lineage as lin
from cellweave.operators import scoring, tracking
from cellweave.operators import selection as sel

from test_reference import frames_df, image

DECISIONS = "dataset_id STRING, t INT, action STRING, drop_reason STRING, chosen_ops_json STRING, chosen_idx INT"
SPANS = "dataset_id STRING, t_a INT, t_b INT, score DOUBLE, ops_json STRING"


def resolved(rows, spans, tau, gap):
    """Drops in order, one after the other."""
    out = {(r[0], r[1]): (r[2], r[3], None, None) for r in rows}
    for d in {r[0] for r in rows}:
        bridged, taken = set(), {}
        for t in sorted(r[1] for r in rows if r[0] == d and r[2] == "DROP" and r[3] == "ANOMALY"):
            if t in bridged:
                continue
            for delta in range(2, gap + 1):
                near = [(s[3], -s[1]) for s in spans if s[0] == d and s[2] - s[1] == delta and s[1] <= t < s[2]]
                if near and max(near)[0] >= tau:
                    taken[-max(near)[1]] = (-max(near)[1] + delta, max(near)[0])
                    bridged.update(range(-max(near)[1], -max(near)[1] + delta))
                    break
        for (x, t), (action, reason, *_) in list(out.items()):
            if x != d:
                continue
            if t in bridged:
                a, (b, score) = next((a, v) for a, v in taken.items() if a <= t < v[0])
                out[x, t] = ("BRIDGE", None, (a, b, score), a == t)
            elif action == "DROP" and reason == "ANOMALY":
                out[x, t] = ("DROP", "BRIDGE_FAILED", None, None)
    return out


def test_bridges_as_if_drops_came_one_by_one(spark):
    r = random.Random(4)
    rows = [(d, t, *r.choice([("KEEP", None), ("DROP", "ANOMALY"), ("DROP", "ANOMALY"), ("DROP", "DISAGREEMENT")]), None, None) for d in "xyz" for t in range(40)]
    spans = [(d, t, t + k, round(r.random(), 2), f"{t}/{k}") for d in "xyz" for t in range(40) for k in (2, 3, 4) if r.random() < 0.6]
    df = tracking.bridge_drops(spark.createDataFrame(rows, DECISIONS), spark.createDataFrame(spans, SPANS), 0.6, 4)
    got = df.collect()
    want = resolved(rows, spans, 0.6, 4)
    assert len(got) == len(rows)
    for x in got:
        action, reason, span, primary = want[x["dataset_id"], x["t"]]
        assert (x["action"], x["drop_reason"]) == (action, reason)
        assert (None if span is None else span) == (None if x["bridge_t_a"] is None else (x["bridge_t_a"], x["bridge_t_b"], x["bridge_score"]))
        assert x["bridge_is_primary"] == bool(primary) and x["bridge_ops_json"] == (f"{span[0]}/{span[1] - span[0]}" if primary else None)
    assert sel.decision_errors(df).select("error").distinct().collect() == [("kept without a candidate",)]
    assert tracking.bridge_drops(spark.createDataFrame([], DECISIONS), spark.createDataFrame([], SPANS), 0.5, 3).count() == 0


def test_a_lineage_goes_on_over_a_bridge_and_breaks_at_a_drop(spark):
    link = lambda a, b: f'[["link", {a}, {b}, null]]'
    rows = [("d", 0, "KEEP", None, link(1, 1), 1), ("d", 1, "DROP", "ANOMALY", None, None), ("d", 2, "KEEP", None, link(9, 9), 1), ("d", 3, "KEEP", None, link(1, 1), 1), ("d", 4, "DROP", "ANOMALY", None, None), ("d", 5, "KEEP", None, link(1, 1), 1)]
    decided = tracking.bridge_drops(spark.createDataFrame(rows, DECISIONS), spark.createDataFrame([("d", 1, 3, 0.9, link(1, 1))], SPANS), 0.5, 2)
    item = {"label": 1, "x": 0.0, "y": 5.0, "area": 9.0, "length": 3.0, "border": False}
    arrays = spark.createDataFrame([("d", t, [item]) for t in range(7)], f"dataset_id STRING, t INT, cells ARRAY<{tracking.CELL}>")
    tracks, events, _ = tracking.reconstruct(tracking.decided_operations(decided), arrays)
    assert sorted((r["track_id"], r["t"]) for r in tracks.collect()) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 5), (2, 6)]
    assert sorted((r["t"], r["dst_t"]) for r in events.collect()) == [(0, 1), (1, 3), (3, 4), (5, 6)]


def test_masks_overlap_after_a_shift(spark):
    r = np.random.default_rng(3)
    frames = [r.integers(0, 4, (9, 7)).astype(np.uint32) for _ in range(2)]
    df = frames_df(spark, frames)
    links = [("d", 0, s, 1, d, k) for s in (1, 2, 3) for d in (1, 2, 3) for k in (-2, 0, 3)] + [("d", 0, 1, 1, 77, 0)]
    got = tracking.shifted_overlaps(spark.createDataFrame(links, "dataset_id STRING, t INT, src INT, k INT, dst INT, shift INT"), tracking.mask_runs(df), df.select("dataset_id", "height").distinct()).collect()
    assert len(got) == len(links)
    for x in got:
        a, b = frames[0] == x["src"], np.zeros((9, 7), bool)
        for row in range(9):
            if 0 <= row + x["shift"] < 9:
                b[row + x["shift"]] = frames[1][row] == x["dst"]
        assert x["iou"] == pytest.approx((a & b).sum() / (a | b).sum())


def test_overlap_of_links_goes_with_their_candidates(spark):
    df = frames_df(spark, [image((20, 6), _1=(2, 6, 1, 5), _2=(10, 15, 1, 5)), image((20, 6), _1=(4, 8, 1, 5), _2=(10, 15, 2, 6))])
    cells = tracking.cells_from_frames(df)
    o = lambda kind, src, a=None: {"kind": kind, "src": src, "dst1": a, "dst2": None}
    truth = spark.createDataFrame([("d", 0, "p", 1, [o("link", 1, 1), o("link", 2, 2)]), ("d", 0, "p", 2, [o("exit", 1)])], f"dataset_id STRING, t INT, pair_id STRING, sample_rank INT, ops ARRAY<{ops.OP}>")
    got = {x["sample_rank"]: x["link_iou_shifted_median"] for x in tracking.link_ious(truth, cells, tracking.mask_runs(df), df.select("dataset_id", "height").distinct()).collect()}
    assert got == {1: pytest.approx((1 + 15 / 25) / 2), 2: None}
    exact = tracking.sequence_costs(truth, cells, costs.TrackerParams()).collect()
    assert {x["sample_rank"]: x["cost"] for x in exact} == {1: pytest.approx(0.04), 2: 7.5}


def test_shape_of_a_box_and_flags_at_the_open_end(spark):
    runs = tracking.mask_runs(frames_df(spark, [image((30, 30), _1=(4, 16, 3, 7), _2=(20, 23, 20, 23))]))
    got = {x["label"]: x for x in lin.cell_properties(runs).collect()}
    assert got[1]["major_axis_length_px"] == pytest.approx(4 * math.sqrt(144 / 12)) and got[1]["minor_axis_length_px"] == pytest.approx(4 * math.sqrt(16 / 12))
    assert got[1]["orientation"] == pytest.approx(0) and got[1]["eccentricity"] == pytest.approx(math.sqrt(1 - 16 / 144)) and got[2]["eccentricity"] == pytest.approx(0)
    tracks = spark.createDataFrame([("d", 1, 0, 5, 1.0, 1.0, 9.0, 10.0), ("d", 1, 1, 6, 1.0, 1.0, 9.0, 4.0), ("d", 2, 0, 7, 1.0, 1.0, 9.0, 10.0), ("d", 2, 1, 8, 1.0, 1.0, 9.0, 4.0)], "dataset_id STRING, track_id INT, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, axis_len DOUBLE")
    none = spark.createDataFrame([], "dataset_id STRING, t_div INT, mother_track_id INT, d1_track_id INT, d2_track_id INT")
    edge = spark.createDataFrame([("d", 1, 8), ("d", 0, 6)], "dataset_id STRING, t INT, label INT")
    assert [x["src_track_id"] for x in lin.length_flags(tracks, none, at_open_end=edge).collect()] == [1]
    assert lin.length_flags(tracks, none).count() == 2


def test_families_are_fitted_and_models_stored(spark, tmp_path):
    rng = np.random.default_rng(0)
    g, b = rng.gamma(2.5, 1.7, 40_000), rng.beta(2.0, 5.0, 40_000)
    assert scoring.fit_gamma(g.mean(), np.log(g).mean()) == pytest.approx((2.5, 1.7), rel=0.05)
    assert scoring.fit_beta(b.mean(), b.var(), np.log(b).mean(), np.log1p(-b).mean()) == pytest.approx((2.0, 5.0), rel=0.05)
    rows = [(f"p{i // 3}", i % 3, f"d{i % 5}", i % 3 == 0, float(rng.gamma(2 + 3 * (i % 3 == 0), 1.0)), float(rng.beta(2 + 4 * (i % 3 == 0), 3)) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "pair_id STRING, sample_rank INT, dataset_id STRING, is_correct BOOLEAN, max_shrink_pct DOUBLE, link_iou_shifted_median DOUBLE")
    names = ["max_shrink_pct", "link_iou_shifted_median"]
    bayes = scoring.fit_naive_bayes(df, names, prior="uniform_within_pair")
    assert {p[1] for p in bayes.parameters.values()} == {"gamma", "beta"}
    scored = bayes.score(df)
    bayes.save(spark, str(tmp_path / "nb"))
    again = scoring.NaiveBayes.load(spark, str(tmp_path / "nb"))
    assert again.prior == bayes.prior and again.parameters == bayes.parameters
    mean = {x["is_correct"]: x["m"] for x in scored.groupBy("is_correct").agg(F.avg("candidate_correctness_probability").alias("m")).collect()}
    assert mean[True] > mean[False] + 0.2 and bayes.fitted_params(spark).count() == 4
    pairs = df.withColumnRenamed("is_correct", "has_error")
    detector = scoring.train_detector(pairs, names, 0.9, folds=0, name="logreg_l2_balanced")
    found = detector.detect(pairs).join(pairs.select("pair_id", "sample_rank", "has_error"), "pair_id").where("has_error AND sample_rank = 0")
    assert detector.detect(pairs).count() == 300 and found.count() > 0
    detector.save(spark, str(tmp_path / "detector"))
    loaded = scoring.Detector.load(spark, str(tmp_path / "detector"))
    assert loaded.threshold == detector.threshold
    key = lambda d: sorted(map(tuple, d.detect(pairs).select("pair_id", F.round("anomaly_score", 9), "anomaly_flag").collect()))
    assert key(loaded) == key(detector)
    assert 0 <= scoring.train_detector(pairs, names, 0.9, folds=2, name="logreg_l2_balanced").threshold <= 1
