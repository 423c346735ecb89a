"""Column contracts of the tables, as Spark DDL, and helpers on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "max_shrink_pct", "total_area_ratio_exit_adjusted", "exit_open_end_dist_median_norm", "link_area_ratio_median", "link_area_ratio_max", "link_dy_median_norm",
    "link_dy_max_norm", "link_iou_shifted_median", "div_mother_sum_area_ratio_max", "div_mother_sum_area_ratio_mean", "div_daughter_area_ratio_max",
    "div_daughter_area_ratio_mean", "div_mother_daughter_dy_max_norm", "div_mother_daughter_dy_mean_norm",
)
DIVISION_FEATURES = tuple(f for f in FEATURES if f.startswith("div_"))
# fixed values: the features of the reduced set
REDUCED = (
    "max_shrink_pct", "total_area_ratio_exit_adjusted", "exit_open_end_dist_median_norm", "link_area_ratio_median", "link_dy_max_norm", "link_iou_shifted_median",
    "div_mother_sum_area_ratio_mean", "div_daughter_area_ratio_mean", "div_mother_daughter_dy_mean_norm",
)
FEATURE_SETS = {
    "all": FEATURES,
    "reduced_v1": REDUCED,
    "division": DIVISION_FEATURES,
    "non_division": tuple(f for f in FEATURES if f not in DIVISION_FEATURES),
    "all_plus_counts": (*FEATURES, "n_links", "n_exits", "n_divides"),
}

TRACKS = "dataset_id STRING, track_id INT, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, axis_len DOUBLE"
EVENTS = "dataset_id STRING, t INT, event STRING, src_label INT, dst1_label INT, dst2_label INT, track_id INT, cost DOUBLE, dst_t INT"
DIVISIONS = "dataset_id STRING, t_div INT, mother_track_id INT, d1_track_id INT, d2_track_id INT"
CELLS = "dataset_id STRING, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, bbox_minr INT, bbox_minc INT, bbox_maxr INT, bbox_maxc INT"
FRAMES = "dataset_id STRING, t INT, height INT, width INT, pixels BINARY"
MANIFEST = (
    "dataset_id STRING, axis STRING, open_end STRING, approved_labels_dir STRING, labels_dir STRING, images_dir STRING, gt_tracks_csv STRING, gt_divisions_csv STRING, "
    "frame_interval_min DOUBLE, dataset_kind STRING, segmentation_run_dir STRING, segmentation_qc_report STRING, notes STRING"
)
OPS = "array<array<string>>"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df's columns in the contract's order and types; a column that is absent becomes NULL, others are left out."""
    fields = T.StructType.fromDDL(ddl).fields
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def value(c: Column | str) -> Column:
    """NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """NaN and infinities as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
