"""Reading manifests, ground truth, run folders and parquet; writing lineages and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.schemas import DIVISIONS, EVENTS, MANIFEST, TRACKS, conform


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A dataset manifest from CSV with a header, or YAML (a list, or a mapping with `datasets`); blanks are NULL."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(Path(path).read_text()) or []
        rows = found.get("datasets", []) if isinstance(found, dict) else found
        names = [f.name for f in T.StructType.fromDDL(MANIFEST).fields]
        df = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"{n} STRING" for n in names))
    elif path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
    else:
        raise ValueError(f"a manifest is CSV or YAML: {path}")
    blank = df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns])
    out = conform(blank.withColumn("frame_interval_min", F.col("frame_interval_min").try_cast("double")) if "frame_interval_min" in df.columns else blank, MANIFEST)
    return out.withColumn("effective_labels_dir", F.coalesce("approved_labels_dir", "labels_dir"))


def read_truth(spark: SparkSession, tracks_csv: str, divisions_csv: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Tracks and divisions of a dataset from CSV; daughters may be named d1_track_id or daughter1_track_id. A (t, label) or a mother
    that stands twice is an error."""
    t = spark.read.csv(tracks_csv, header=True)
    d = spark.read.csv(divisions_csv, header=True)
    for k in ("1", "2"):
        if f"d{k}_track_id" not in d.columns:
            d = d.withColumnRenamed(f"daughter{k}_track_id", f"d{k}_track_id")
    tracks, divisions = (conform(x.withColumn("dataset_id", F.lit(dataset_id)), ddl) for x, ddl in ((t, TRACKS), (d, DIVISIONS)))
    for df, keys in ((tracks, ["t", "label"]), (divisions, ["mother_track_id"])):
        twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{', '.join(keys)} stands twice: {[twice[0][k] for k in keys]}")
    return tracks, divisions


def require_known(rows: DataFrame, manifest: DataFrame) -> None:
    """Raises if rows name a dataset that the manifest doesn't."""
    unknown = rows.select("dataset_id").where("dataset_id IS NOT NULL").distinct().join(manifest.select("dataset_id"), "dataset_id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"datasets without a manifest row: {', '.join(r[0] for r in unknown)}")


def write_lineage(tracks: DataFrame, events: DataFrame, divisions: DataFrame, folder: str, csv: bool = False) -> None:
    """Three tables, a folder per dataset in each; refuses to overwrite."""
    for name, df in (("tracks", tracks), ("events", events), ("division_events", divisions)):
        writer = df.write.mode("errorifexists").partitionBy("dataset_id")
        writer.csv(f"{folder}/{name}", header=True) if csv else writer.parquet(f"{folder}/{name}")


def read_lineage(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = (("tracks", TRACKS), ("events", EVENTS), ("division_events", DIVISIONS))
    return tuple(spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in named)  # type: ignore[return-value]


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as CSV with a header; maps as JSON."""
    maps = [f.name for f in findings.schema.fields if isinstance(f.dataType, T.MapType)]
    findings.select(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in findings.columns]).write.mode("errorifexists").csv(path, header=True)


def write_metadata(path: str, **facts: object) -> None:
    """A JSON file beside a run's tables."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    target.write_text(json.dumps(facts, indent=1, sort_keys=True, default=str) + "\n")
