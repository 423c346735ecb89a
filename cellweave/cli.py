"""Command line: python -m cellweave.cli track | seg-qc | analyse, over folders of label images and lineage tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellweave.functions.costs import TrackerParams, touches_open
from cellweave.operators import lineage, quality, tracking
from cellweave.sources import labels, tables


def track(spark: SparkSession, folder: str, dataset_id: str, out: str, params: TrackerParams = TrackerParams(), top_k: int = 16) -> None:
    """Label images to tracks, events and divisions, by the cheapest operations of each pair; candidates are written beside them."""
    frames = labels.read_label_folder(spark, folder, dataset_id)
    shape = frames.groupBy("dataset_id").agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    cells = tracking.cells_from_frames(frames).join(shape, "dataset_id")
    box = F.struct("bbox_minr", "bbox_minc", "bbox_maxr", "bbox_maxc")
    length = F.col("bbox_maxr") - F.col("bbox_minr") if params.axis == "y" else F.col("bbox_maxc") - F.col("bbox_minc")
    arrays = tracking.frame_arrays(cells.withColumn("border", touches_open(params, box, F.col("_h"), F.col("_w"))).withColumn("length", length), params)
    found = tracking.generate_candidates(tracking.frame_pairs(arrays), params, top_k)
    found.drop("ops").write.mode("errorifexists").parquet(f"{out}/candidates")
    tables.write_lineage(*tracking.reconstruct(found.where("is_dpt_best").select("dataset_id", "t", "ops"), arrays), out)


def check(spark: SparkSession, folder: str, dataset_id: str, out: str, least: float) -> None:
    tables.write_findings(quality.basic_checks(tracking.cells_from_frames(labels.read_label_folder(spark, folder, dataset_id)).select("dataset_id", "t", "label", "area"), least), out)


def analyse(spark: SparkSession, folder: str, out: str) -> None:
    """Lineage tables to cycles with metrics and to length flags."""
    tracks, events, divisions = tables.read_lineage(spark, folder)
    rows = lineage.track_rows(tracks)
    cycles = lineage.cycles(rows, lineage.division_rows(divisions), events.where("event = 'exit'"))
    none = spark.createDataFrame([], "dataset_id STRING, frame_interval_min DOUBLE")
    cycles.join(lineage.metrics(rows, none), ["dataset_id", "track_id"], "left").write.mode("errorifexists").parquet(f"{out}/cycles")
    lineage.length_flags(rows, lineage.division_rows(divisions)).write.mode("errorifexists").parquet(f"{out}/consistency_flags")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cellweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("track", "seg-qc"):
        p = commands.add_parser(name)
        p.add_argument("--labels", required=True)
        p.add_argument("--dataset-id", required=True)
        p.add_argument("--out", required=True)
        if name == "track":
            p.add_argument("--axis", choices=("x", "y"), default="y")
            p.add_argument("--open-end", choices=("low", "high"), default="low")
            p.add_argument("--top-k", type=int, default=16)
        else:
            p.add_argument("--least", type=float, default=20.0)
    p = commands.add_parser("analyse")
    p.add_argument("--lineage", required=True)
    p.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    if a.command == "track":
        track(spark, a.labels, a.dataset_id, a.out, TrackerParams(axis=a.axis, open_end=a.open_end), a.top_k)
    elif a.command == "seg-qc":
        check(spark, a.labels, a.dataset_id, a.out, a.least)
    else:
        analyse(spark, a.lineage, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
