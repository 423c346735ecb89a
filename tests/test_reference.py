"""Operators on images, candidates and lineages: hand-made fixtures and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import costs, ops
from cellweave.operators import lineage as lin
from cellweave.operators import quality, scoring, tracking
from cellweave.operators import selection as sel
from cellweave.schemas import FEATURES
from cellweave.sources import labels, tables

PARAMS = costs.TrackerParams()


def frames_df(spark, images, dataset="d"):
    rows = [(dataset, t, i.shape[0], i.shape[1], bytearray(i.astype("<u4").tobytes())) for t, i in enumerate(images)]
    return spark.createDataFrame(rows, "dataset_id STRING, t INT, height INT, width INT, pixels BINARY")


def image(shape, **boxes):
    out = np.zeros(shape, np.uint32)
    for name, (r0, r1, c0, c1) in boxes.items():
        out[r0:r1, c0:c1] = int(name[1:])
    return out


def tracked(cells, params=PARAMS, height=10**6):
    length = F.col("bbox_maxr") - F.col("bbox_minr")
    border = costs.touches_open(params, F.struct("bbox_minr", "bbox_maxr", "bbox_minc", "bbox_maxc"), F.lit(height), F.lit(height))
    return tracking.frame_arrays(cells.withColumn("length", length).withColumn("border", border), params)


def test_cells_of_a_small_image(spark):
    got = {r["label"]: r for r in tracking.cells_from_frames(frames_df(spark, [image((6, 7), _1=(0, 2, 0, 1), _2=(3, 5, 4, 6)), np.zeros((6, 7))])).collect()}
    a, b = got[1], got[2]
    assert (a["area"], a["x"], a["y"], a["bbox_minr"], a["bbox_minc"], a["bbox_maxr"], a["bbox_maxc"]) == (2, 0, 0.5, 0, 0, 2, 1)
    assert (b["area"], b["x"], b["y"], b["bbox_minr"], b["bbox_minc"], b["bbox_maxr"], b["bbox_maxc"]) == (4, 4.5, 3.5, 3, 4, 5, 6)


def cell(label, y, area, length=10.0, border=False):
    return {"label": label, "x": 0.0, "y": float(y), "area": float(area), "length": length, "border": border}


def test_costs_of_single_operations():
    assert tracking.k_best([cell(1, 10, 10)], [cell(11, 12, 10)], PARAMS, 4)[0] == (pytest.approx(0.04), "l")
    high = costs.TrackerParams(open_end="high")
    found = tracking.k_best([cell(1, 90, 20), cell(2, 50, 20)], [cell(20, 50, 20)], high, 4)
    assert found[0] == (pytest.approx(7.5), "el")
    assert tracking.k_best([cell(1, 1, 1)], [cell(k, k, 1) for k in (1, 2, 3)], PARAMS, 4) == []
    assert tracking.k_best([], [], PARAMS, 4) == [(0.0, "")] and tracking.k_best([], [cell(1, 1, 1)], PARAMS, 4) == []
    barred = costs.TrackerParams(sum_area_tol=0.2)
    assert dict((s, c) for c, s in tracking.k_best([cell(1, 5, 10)], [cell(1, 4, 20), cell(2, 6, 20)], barred, 4))["d"] == 1e9


def sequences(n, m, i=0, j=0, done=""):
    if i == n:
        return [done] if j == m else []
    out = sequences(n, m, i + 1, j, done + "e") if set(done) <= {"e"} else []
    for letter, width in (("l", 1), ("d", 2)):
        if j + width <= m:
            out += sequences(n, m, i + 1, j + width, done + letter)
    return out


def test_numbers_of_candidates():
    assert [tracking.count_candidates(*x) for x in ((0, 0), (2, 2), (3, 4), (11, 19), (1, 3))] == [1, 2, 4, 175, 0]
    assert all(tracking.count_candidates(n, m) == len(sequences(n, m)) for n in range(6) for m in range(9))
    with pytest.raises(ValueError):
        tracking.count_candidates(-1, 0)


def test_k_best_is_the_head_of_all_sequences(spark):
    r = random.Random(1)
    rows, pairs = {}, []
    for p in range(12):
        n, m = r.randrange(1, 5), r.randrange(0, 7)
        a = [cell(i + 1, 10 * i + r.random(), r.uniform(50, 90)) for i in range(n)]
        b = [cell(i + 1, 8 * i + r.random(), r.uniform(20, 90), border=i == 0 and r.random() < 0.5) for i in range(m)]
        link, divide = tracking._pair_costs(a, b, PARAMS)
        every = []
        for s in sequences(n, m):
            j, c, e = 0, 0.0, 0
            for i, x in enumerate(s):
                if x == "e":
                    e += 1
                    c += 3 + 4.5 * (2 * e - 1)
                elif x == "l":
                    c, j = c + link[i, j], j + 1
                else:
                    c, j = c + divide[i, j], j + 2
            every.append((c, s))
        rows[f"p{p}"] = {s for _, s in every}
        pairs.append(("d", f"p{p}", p, 1, a, b))
        got = tracking.k_best(a, b, PARAMS, 1000)
        assert sorted(s for _, s in got) == sorted(s for _, s in every)
        assert [c for c, _ in got] == pytest.approx(sorted(c for c, _ in every))
        assert [c for c, _ in tracking.k_best(a, b, PARAMS, 2)] == pytest.approx(sorted(c for c, _ in every)[:2])
    df = spark.createDataFrame(pairs, f"dataset_id STRING, pair_id STRING, t INT, delta_t INT, a ARRAY<{tracking.CELL}>, b ARRAY<{tracking.CELL}>")
    got = {}
    for x in tracking.enumerate_candidates(df).collect():
        got.setdefault(x["pair_id"], set()).add(x["steps"])
    assert got == {k: v for k, v in rows.items() if v}
    best = tracking.generate_candidates(df, PARAMS, top_k=3)
    assert best.groupBy("pair_id").count().agg(F.max("count")).first()[0] <= 3
    assert best.where(ops.error(F.col("ops")).isNotNull()).count() == 0


def test_stable_stack_gives_two_tracks(spark):
    p = costs.TrackerParams(open_end="high")
    arrays = tracked(tracking.cells_from_frames(frames_df(spark, [image((36, 9), _1=(5, 12, 2, 8), _2=(19, 28, 2, 8))] * 5)), p, 36)
    best = tracking.generate_candidates(tracking.frame_pairs(arrays), p, 1)
    tracks, events, divisions = tracking.reconstruct(best.select("dataset_id", "t", "ops"), arrays)
    got = sorted((r["track_id"], r["t"], r["label"]) for r in tracks.collect())
    assert got == [(1, t, 2) for t in range(5)] + [(2, t, 1) for t in range(5)]
    assert events.count() == 8 and divisions.count() == 0


def test_lineage_with_division_exit_and_break(spark):
    frames = {0: [1, 2], 1: [1, 2, 3], 2: [1, 2], 3: [5, 6]}
    rows = [("d", t, [{**cell(x, 10 * x, 50)} for x in v]) for t, v in frames.items()]
    arrays = spark.createDataFrame(rows, f"dataset_id STRING, t INT, cells ARRAY<{tracking.CELL}>")
    o = lambda kind, src, a=None, b=None: {"kind": kind, "src": src, "dst1": a, "dst2": b}
    chosen = [("d", 0, [o("link", 1, 1), o("divide", 2, 2, 3)]), ("d", 1, None), ("d", 2, [o("link", 1, 5), o("exit", 2), o("link", 9, 6)])]
    df = spark.createDataFrame(chosen, f"dataset_id STRING, t INT, ops ARRAY<{ops.OP}>")
    tracks, events, divisions = tracking.reconstruct(df, arrays)
    got = sorted((r["track_id"], r["t"], r["label"]) for r in tracks.collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (3, 1, 2), (4, 1, 3), (5, 2, 1), (5, 3, 5), (6, 2, 2), (7, 3, 6)]
    assert [tuple(r) for r in divisions.collect()] == [("d", 0, 2, 3, 4)]
    assert {(r["event"], r["track_id"]) for r in events.collect()} == {("link", 1), ("divide", 2), ("link", 5), ("exit", 6), ("link", 7)}


def test_operation_lists(spark):
    rows = [
        ('[["exit", 1, null, null], ["divide", 2, 12, 11], ["link", 3, 13, null]]', None), ('[["link", 1, 2, null], ["exit", 3, null, null]]', "exit after another operation"),
        ('[["link", 1, 2, null], ["link", 1, 3, null]]', "source used twice"), ('[["link", 1, 2, null], ["link", 2, 2, null]]', "destination used twice"), ('[["link", 1, null, null]]', "wrong number of destinations"),
        ('[["jump", 1, 2, null]]', "unknown kind"), ("nonsense", "not a list of operations"), ("[]", None),
    ]
    df = spark.createDataFrame(rows, "ops_json STRING, wanted STRING")
    o = ops.parse("ops_json")
    got = df.select("ops_json", "wanted", ops.error(o).alias("e"), ops.format_ops(o).alias("again"), ops.canonical(o).alias("key"), ops.compact(o).alias("short")).collect()
    assert [r["e"] for r in got] == [r["wanted"] for r in got]
    assert got[0]["again"] == rows[0][0] and got[0]["key"] == "1:exit:-1:-1|2:divide:11:12|3:link:13:-1" and got[0]["short"] == "lde"
    grown = spark.createDataFrame([("l, d e",), ("link divide exit",), ("lx",), ("ll",)], "s STRING").select(ops.expand(ops.from_compact(F.col("s")), F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (11, 12, 13)))).alias("o")).collect()
    want = [("exit", 1, None, None), ("divide", 2, 11, 12), ("link", 3, 13, None)]
    assert [tuple(x) for x in grown[0]["o"]] == [tuple(x) for x in grown[1]["o"]] == want and grown[2]["o"] is None and grown[3]["o"] is None


def test_costs_as_columns(spark):
    row = spark.range(1).select(
        costs.link_cost(PARAMS, F.lit(2.0), F.lit(10.0), F.lit(10.0)).alias("l"), costs.exits_cost(PARAMS, F.lit(3)).alias("e"), (costs.exit_cost(PARAMS, F.lit(1)) + costs.exit_cost(PARAMS, F.lit(2)) + costs.exit_cost(PARAMS, F.lit(3))).alias("s"),
        costs.divide_cost(costs.TrackerParams(max_area_tol=0.2), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(1.0)).alias("d"),
    ).first()
    assert row["l"] == pytest.approx(0.04) and row["e"] == row["s"] == pytest.approx(49.5) and row["d"] == 1e9


def scored_pairs(spark):
    rows = [("p0", 1, 0, 2.0, 0.1, "A"), ("p0", 2, 0, 1.0, 0.9, "B"), ("p1", 1, 1, 5.0, 0.7, "C"), ("p1", 2, 1, 3.0, 0.2, "D"), ("p2", 1, 2, float("nan"), None, "E"), ("p3", 1, 3, 1.0, 1.0, "F"), ("p3", 2, 3, 1.0, 1.0, "G")]
    return spark.createDataFrame(rows, "pair_id STRING, sample_rank INT, t INT, dp_cost DOUBLE, raw_score DOUBLE, ops_json STRING")


def test_selection_and_its_ties(spark):
    c = sel.candidates(scored_pairs(spark), "t", "dp_cost", "raw_score", "ops_json")
    pick = lambda name, **o: {r["pair_id"]: (r["chosen_ops_json"], r["chosen_score"]) for r in sel.select(c, name, **o).collect()}
    assert pick("dp_cost_min") == {"p0": ("B", 1.0), "p1": ("D", 3.0), "p3": ("F", 1.0)}
    assert pick("classifier") == {"p0": ("B", 0.9), "p1": ("C", 0.7), "p3": ("F", 1.0)}
    assert pick("ensemble_rank", alpha=1.0)["p1"][0] == "D" and pick("ensemble_rank", alpha=0.0)["p1"][0] == "C"
    assert pick("ensemble_zscore", alpha=1.0)["p1"][0] == "D" and pick("ensemble_zscore", alpha=0.0)["p1"][0] == "C"
    with pytest.raises(ValueError):
        sel.select(c, "other")
    p = {(r["pair_id"], r["sample_rank"]): r for r in sel.pair_probabilities(c).collect()}
    assert p["p3", 1]["pair_probability"] == 0.5 and (p["p3", 1]["score_rank"], p["p3", 2]["score_rank"]) == (1, 2)
    assert p["p2", 1]["pair_probability"] is None and p["p2", 1]["score_rank"] is None


def test_per_pair_features_have_86_columns(spark):
    rows = [(f"p{p}", i + 1, "d", p, 0.1 + 0.2 * i, 0.5 - 0.2 * i, (0.6, 0.3, 0.1)[i], *[float(i + 1)] * 14) for p in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "pair_id STRING, sample_rank INT, dataset_id STRING, t INT, dp_cost DOUBLE, raw_score DOUBLE, pair_probability DOUBLE, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    got = sel.per_pair_features(df).collect()
    assert len(got) == 2 and len(got[0]) == 86
    r = got[0]
    assert (r["max_shrink_pct_max"], r["max_shrink_pct_min"], r["max_shrink_pct_mean"], r["max_shrink_pct_best"]) == (3, 1, 2, 1)
    assert r["score_margin_top1_top2"] == pytest.approx(0.2) and r["score_entropy"] == pytest.approx(-sum(p * math.log(p) for p in (0.6, 0.3, 0.1)))


def test_cycles_of_a_forest(spark):
    spans = {1: [0, 1], 2: [2, 3, 4], 3: [2, 3, 4, 5], 6: [6], 7: [6], 4: [3, 4, 5], 5: [2, 4]}
    tracks = spark.createDataFrame([("d", k, t, k, 0.0, float(k), 10.0, 10.0) for k, ts in spans.items() for t in ts], "dataset_id STRING, track_id INT, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, axis_len DOUBLE")
    div = spark.createDataFrame([("d", 1, 1, 2, 3), ("d", 5, 3, 6, 7)], "dataset_id STRING, t_div INT, mother_track_id INT, d1_track_id INT, d2_track_id INT")
    gone = spark.createDataFrame([("d", 2), ("d", -1)], "dataset_id STRING, track_id INT")
    c = {r["track_id"]: r for r in lin.cycles(tracks, div, gone).collect()}
    assert [c[k]["generation"] for k in (1, 2, 3, 6, 7)] == [0, 1, 1, 2, 2]
    assert c[5]["n_gap_frames"] == 1 and not c[4]["birth_observed"] and c[2]["end_cause"] == "exited" and c[3]["end_cause"] == "divided" and c[7]["end_cause"] == "censored"
    assert c[3]["complete_cycle"] and not c[1]["complete_cycle"]
    ends = spark.createDataFrame([("d", "high")], "dataset_id STRING, open_end STRING")
    branch = [(r["step"], r["track_id"]) for r in lin.mother_branch(tracks, div, ends).orderBy("step").collect()]
    assert branch == [(0, 1), (1, 2)]


def test_growth_of_an_exponential(spark):
    rows = [("d", 1, t, 1, 0.0, 0.0, 1.0, math.exp(0.1 * t)) for t in range(5)] + [("d", 2, 0, 1, 0.0, 0.0, 1.0, 3.0)]
    tracks = spark.createDataFrame(rows, "dataset_id STRING, track_id INT, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, axis_len DOUBLE")
    m = {r["track_id"]: r for r in lin.metrics(tracks, spark.createDataFrame([("d", 2.0)], "dataset_id STRING, frame_interval_min DOUBLE")).collect()}
    assert m[1]["cycle_time"] == 10.0 and m[1]["growth_rate"] == pytest.approx(0.05) and m[1]["growth_rate_r2"] == pytest.approx(1) and m[1]["growth_rate_n"] == 5
    assert m[2]["growth_rate"] is None and m[2]["growth_rate_r2"] is None and m[2]["growth_rate_n"] == 1


def test_matching_prefers_pairs_then_overlap():
    assert quality.match_labels([(1, 1, 0.9), (1, 2, 0.6), (2, 1, 0.6)]) == [(1, 2, 0.6), (2, 1, 0.6)]
    r = random.Random(0)
    for _ in range(30):
        edges = list({(p, q): (p, q, round(r.uniform(0.1, 1), 3)) for p, q in ((r.randrange(4), r.randrange(4)) for _ in range(7))}.values())

        def best(i, used):
            if i == 4:
                return (0, 0.0)
            out = best(i + 1, used)
            for p, q, x in edges:
                if p == i and q not in used:
                    n, s = best(i + 1, used | {q})
                    out = max(out, (n + 1, s + x))
            return out

        got = quality.match_labels(edges)
        n, s = best(0, frozenset())
        assert len(got) == n and sum(x for _, _, x in got) == pytest.approx(s)


def test_evaluation_and_checks(spark):
    pixels = lambda img: [("d", 0, r, c, int(img[r, c])) for r in range(img.shape[0]) for c in range(img.shape[1])]
    ddl = "dataset_id STRING, t INT, r INT, c INT, label INT"
    truth = spark.createDataFrame(pixels(np.array([[0, 1, 1, 0], [0, 2, 2, 0]])), ddl)
    pred = spark.createDataFrame(pixels(np.array([[0, 9, 9, 0], [0, 4, 4, 7]])), ddl)
    table = quality.overlaps(pred, truth)
    n = lambda df, name: df.where("label > 0").groupBy("dataset_id", "t", F.col("label").alias(name)).count()
    e = quality.evaluate(table, n(pred, "pred"), n(truth, "truth"))
    assert [(r["tp"], r["n_pred"], r["n_truth"]) for r in e.collect()] == [(2, 3, 2)]
    s = quality.summary(e).first()
    assert s["precision"] == pytest.approx(2 / 3) and s["recall"] == 1 and s["f1"] == pytest.approx(0.8) and s["modsa"] == 0.5
    cells = spark.createDataFrame([("d", 0, 1, 4.0), ("d", 2, 1, 1.0), ("d", 2, 2, 1.0), ("d", 2, 3, 1.0), ("d", 2, 4, 1.0)], "dataset_id STRING, t INT, label INT, area DOUBLE")
    assert {r["check_name"] for r in quality.basic_checks(cells, least=2, count=2, area=0.5).collect()} == {"empty_frame", "small_label", "cell_count_jump", "total_area_jump"}


def test_scorers_tell_classes_apart(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        good = i % 2 == 0
        rows.append((f"p{i // 4}", i % 4, f"d{i % 3}", good if i % 10 else None, *[None if r.random() < 0.1 else math.exp(r.gauss(0.8 if good else 0, 0.5)) for _ in FEATURES]))
    df = spark.createDataFrame(rows, "pair_id STRING, sample_rank INT, dataset_id STRING, is_correct BOOLEAN, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    for scored in (scoring.fit_naive_bayes(df).score(df), scoring.fit_scorer(df).score(df), scoring.score_left_out(df)):
        means = {x["is_correct"]: x["m"] for x in scored.groupBy("is_correct").agg(F.avg("candidate_correctness_probability").alias("m")).collect()}
        assert means[True] > 0.85 and means[False] < 0.15
    scored = scoring.fit_naive_bayes(df).score(df)
    t = scoring.recall_threshold(scored, 0.9)
    kept = scored.where(F.col("is_correct") & (F.col("raw_score") >= t)).count() / scored.where("is_correct").count()
    assert 0.9 <= kept < 0.93
    for method in ("isotonic", "sigmoid"):
        assert scoring.calibrate(df, method=method, folds=2)(df).where("candidate_correctness_probability BETWEEN 0 AND 1").count() == 600
    with pytest.raises(ValueError):
        scoring.fit_scorer(df.where("is_correct"))


def test_tiff_round_trip_and_manifest(spark, tmp_path):
    images = [image((5, 6), _1=(0, 2, 0, 3)), image((5, 6), _70000=(1, 4, 2, 5)), image((5, 6), _3=(0, 1, 0, 1))]
    for i in images:
        assert np.array_equal(labels.decode_tiff(labels.encode_tiff(i)), i)
    labels.write_label_folder(frames_df(spark, images), str(tmp_path))
    back = sorted(labels.read_label_folder(spark, str(tmp_path / "d"), "d").collect(), key=lambda r: r["t"])
    assert [r["t"] for r in back] == [0, 1, 2]
    assert all(np.array_equal(np.frombuffer(bytes(r["pixels"]), "<u4").reshape(5, 6), i) for r, i in zip(back, images))
    (tmp_path / "m.csv").write_text("dataset_id,axis,open_end,approved_labels_dir,labels_dir,frame_interval_min\na,y,high,ok,raw,1.5\nb,y,,,raw,\n")
    (tmp_path / "m.yaml").write_text("datasets:\n- {dataset_id: a, axis: y, labels_dir: raw}\n")
    m = {r["dataset_id"]: r for r in tables.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert m["a"]["effective_labels_dir"] == "ok" and m["a"]["frame_interval_min"] == 1.5 and m["b"]["effective_labels_dir"] == "raw" and m["b"]["open_end"] is None
    assert tables.read_manifest(spark, str(tmp_path / "m.yaml")).first()["effective_labels_dir"] == "raw"
    with pytest.raises(ValueError):
        tables.read_manifest(spark, "m.txt")


def test_features_of_every_candidate(spark):
    rows = [("d", 0, 1, 10.0, 100.0, True), ("d", 0, 2, 30.0, 200.0, False), ("d", 0, 3, 60.0, 300.0, False), ("d", 2, 1, 34.0, 90.0, False), ("d", 2, 2, 66.0, 150.0, False)]
    cells = spark.createDataFrame(rows, "dataset_id STRING, t INT, label INT, y DOUBLE, area DOUBLE, border BOOLEAN")
    two = [("exit", 1, None, None), ("link", 2, 1, None), ("link", 3, 2, None)]
    one = [("exit", 1, None, None), ("exit", 2, None, None), ("divide", 3, 1, 2)]
    made = spark.createDataFrame([("d", 0, 2, "p", 1, two), ("d", 0, 2, "p", 2, one)], f"dataset_id STRING, t INT, delta_t INT, pair_id STRING, sample_rank INT, ops ARRAY<{ops.OP}>")
    heights = spark.createDataFrame([("d", 100.0, "high")], "dataset_id STRING, height DOUBLE, open_end STRING")
    got = {r["sample_rank"]: r for r in tracking.operation_features(made, cells, heights).collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert a["total_area_ratio_exit_adjusted"] == pytest.approx(240 / 500) and b["total_area_ratio_exit_adjusted"] == pytest.approx(240 / 300)
    assert a["exit_open_end_dist_median_norm"] == pytest.approx(0.89) and b["exit_open_end_dist_median_norm"] == pytest.approx((0.89 + 0.69) / 2)
    assert a["max_shrink_pct"] == pytest.approx(55) and a["link_area_ratio_max"] == pytest.approx(200 / 90) and a["link_dy_max_norm"] == pytest.approx(0.06)
    assert a["div_mother_sum_area_ratio_max"] is None and b["link_area_ratio_max"] is None and b["max_shrink_pct"] == 0
    assert b["div_mother_sum_area_ratio_max"] == pytest.approx(300 / 240) and b["div_daughter_area_ratio_mean"] == pytest.approx(150 / 90)


def test_pairs_of_all_sizes_in_one_batch(spark):
    rng = random.Random(5)
    pairs, want = [], {}
    for i, (n, m) in enumerate([(0, 0), (0, 1), (1, 0), (1, 3), (2, 2), (2, 2), (3, 4), (3, 4), (3, 4), (4, 3)]):
        a, b = ([cell(10 * s + k, rng.randint(0, 20), rng.choice((10, 15, 20))) for k in range(1, size + 1)] for s, size in ((1, n), (2, m)))
        if i == 5:
            a[0]["area"], b[1]["label"], b[0]["length"] = None, None, None
        pairs.append(("d", f"p{i}", i, 1, a, b))
        link, divide = tracking._pair_costs(a, b, PARAMS)
        every = []

        def grow(s, j, total, kinds, n=n, m=m, link=link, divide=divide, every=every):
            if s == n:
                return every.append((total, kinds)) if j == m else None
            if j == 0:
                grow(s + 1, 0, total + PARAMS.exit_lin + PARAMS.exit_quad * (2 * s + 1), (*kinds, "exit"))
            for width, kind in ((1, "link"), (2, "divide")):
                if j + width <= m:
                    grow(s + 1, j + width, total + (link if width == 1 else divide)[s, j], (*kinds, kind))

        grow(0, 0, 0.0, ())
        want[f"p{i}"] = sorted(every)[:5]
    schema = f"dataset_id STRING, pair_id STRING, t INT, delta_t INT, a ARRAY<{tracking.CELL}>, b ARRAY<{tracking.CELL}>"
    df = spark.createDataFrame(pairs, schema).coalesce(1)
    assert tracking.generate_candidates(df.where("false"), PARAMS).count() == 0
    got = {}
    for r in tracking.generate_candidates(df, PARAMS, top_k=5).orderBy("pair_id", "sample_rank").collect():
        got.setdefault(r["pair_id"], []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items() if v}
    for k, rows in got.items():
        assert [r["dp_cost"] for r in rows] == pytest.approx([c for c, _ in want[k]])
        assert [r["sample_rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r["n_candidates_pair"] for r in rows} == {len(rows)}
        a, b = pairs[int(k[1:])][4:]
        for r in rows:
            assert [o["src"] for o in r["ops"]] == [c["label"] for c in a]
            used = [x for o in r["ops"] for x in {"link": (o["dst1"],), "divide": (o["dst1"], o["dst2"])}.get(o["kind"], ())]
            assert used == [c["label"] for c in b]


def test_features_with_odd_cells(spark):
    rows = [("d", 0, 1, 5.0, 100.0), ("d", 0, 1, 50.0, 10.0), ("d", 0, None, 7.0, 1.0), ("d", 0, 2, 20.0, None), ("d", 1, 1, 15.0, 50.0)]
    cells = spark.createDataFrame(rows, "dataset_id STRING, t INT, label INT, y DOUBLE, area DOUBLE")
    of = f"dataset_id STRING, t INT, pair_id STRING, ops ARRAY<{ops.OP}>"
    truth = [("d", 0, "p", [("link", 1, 1, None), ("link", 9, 1, None), ("exit", 2, None, None)]), ("d", 0, "q", [("link", 9, 1, None)]), ("d", 0, "r", []), ("d", 0, "s", None), ("d", 1, "u", [("link", 1, 1, None)]), (None, 0, "v", [("exit", 1, None, None)])]
    heights = spark.createDataFrame([("d", 100.0)], "dataset_id STRING, height DOUBLE")
    df = spark.createDataFrame(truth, of)
    got = {r["pair_id"]: r for r in tracking.operation_features(df, cells, heights).collect()}
    assert set(got) == {"p", "u"}
    # of the two cells of label 1 the one with the lesser y; a cell that isn't there and an area that isn't known count for nothing
    assert got["p"]["link_area_ratio_max"] == 2 and got["p"]["link_dy_median_norm"] == pytest.approx(0.1) and got["p"]["exit_open_end_dist_median_norm"] == pytest.approx(0.2)
    assert got["u"]["link_area_ratio_median"] is None and got["u"]["max_shrink_pct"] == 0
    assert tracking.operation_features(df, cells.where("false"), heights).count() == 0
    assert tracking.operation_features(df.where("false"), cells, heights).count() == 0
