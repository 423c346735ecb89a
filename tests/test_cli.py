"""Images to lineages and analyses by the command line; manual corrections."""

import numpy as np

from cellweave import cli
from cellweave.operators import review, tracking
from cellweave.sources import labels


def test_from_images_to_cycles(spark, tmp_path):
    images = []
    for t in range(4):
        i = np.zeros((44, 11), np.uint32)
        i[4:10, 3:8], i[19:28, 3:8] = 1, 2
        images.append(i)
    (tmp_path / "in").mkdir()
    for t, i in enumerate(images):
        (tmp_path / "in" / f"f{t}.tif").write_bytes(labels.encode_tiff(i))
    assert cli.main(["track", "--labels", str(tmp_path / "in"), "--dataset-id", "d", "--open-end", "high", "--out", str(tmp_path / "run"), "--top-k", "3"]) == 0
    assert cli.main(["seg-qc", "--labels", str(tmp_path / "in"), "--dataset-id", "d", "--out", str(tmp_path / "qc"), "--least", "35"]) == 0
    assert cli.main(["analyse", "--lineage", str(tmp_path / "run"), "--out", str(tmp_path / "out")]) == 0
    cycles = spark.read.parquet(str(tmp_path / "out" / "cycles")).collect()
    assert sorted((r["track_id"], r["n_frames"], r["cycle_time"], r["growth_rate"]) for r in cycles) == [(1, 4, 4.0, 0.0), (2, 4, 4.0, 0.0)]
    assert spark.read.csv(str(tmp_path / "qc"), header=True).where("check_name = 'small_label'").count() == 4


def test_corrections_take_the_place_of_choices(spark):
    cell = lambda k: {"label": k, "x": 0.0, "y": float(k), "area": 10.0, "length": 1.0, "border": False}
    pairs = spark.createDataFrame([("d", "d:0->1", 0, 1, [cell(1), cell(2)], [cell(11), cell(12)])], f"dataset_id STRING, pair_id STRING, t INT, delta_t INT, a ARRAY<{tracking.CELL}>, b ARRAY<{tracking.CELL}>")
    candidates = spark.createDataFrame([("d:0->1", 1, 0.5, '[["link", 1, 11, null], ["link", 2, 12, null]]')], "pair_id STRING, sample_rank INT, dp_cost DOUBLE, ops_json STRING")
    chosen = spark.createDataFrame([("d:0->1", 0, 1, 0.5, "old")], "pair_id STRING, t INT, chosen_idx INT, chosen_score DOUBLE, chosen_ops_json STRING")
    fixes = lambda s: review.corrections(spark.createDataFrame([("d", 0, s)], "dataset_id STRING, t INT, sequence STRING"), pairs, candidates)
    same, other, wrong = (review.corrected(chosen, fixes(s)).first() for s in ("ll", "de", "lll"))
    assert same["chosen_idx"] == 1 and same["corrected"] and same["chosen_score"] == 0.5
    assert other["chosen_idx"] is None and other["chosen_ops_json"] == '[["exit", 1, null, null], ["divide", 2, 11, 12]]'
    assert wrong["chosen_ops_json"] == "old" and not wrong["corrected"]
    assert review.cost_above_best(candidates).first()["dp_cost_delta"] == 0
