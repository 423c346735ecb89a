"""Manual corrections of selections, and tables for drawing lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import ops
from cellweave.operators.positions import with_positions

KEY = ["dataset_id", "track_id"]


def corrections(overrides: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """overrides(dataset_id, t, sequence: compact, from the closed end) expanded over the pair's cells, checked and looked up.

    pairs: as tracking.frame_pairs gives them; candidates: (pair_id, sample_rank, dp_cost, ops_json). A sequence that a candidate has
    keeps its rank and cost, another one has NULLs; one that can't be has an error and no operations.
    """
    labels = lambda c: F.transform(c, lambda x: x["label"])
    j = overrides.join(pairs.select("dataset_id", "t", "pair_id", labels("a").alias("_a"), labels("b").alias("_b")), ["dataset_id", "t"], "left")
    j = j.withColumn("ops", ops.expand(ops.from_compact(F.col("sequence")), F.col("_a"), F.col("_b")))
    error = F.when(F.col("pair_id").isNull(), "no such pair").when(F.col("ops").isNull(), "the sequence doesn't fit the cells").otherwise(ops.error(F.col("ops")))
    j = j.withColumn("error", error).withColumn("key", F.when(error.isNull(), ops.canonical(F.col("ops"))))
    known = candidates.withColumn("key", ops.canonical(ops.parse("ops_json"))).groupBy("pair_id", "key").agg(F.min(F.struct("sample_rank", "dp_cost")).alias("c"))
    out = j.join(known, ["pair_id", "key"], "left")
    return out.select("dataset_id", "pair_id", "t", "sequence", F.when(F.col("error").isNull(), ops.format_ops(F.col("ops"))).alias("corrected_ops_json"), F.col("c.sample_rank").alias("candidate_rank"), F.col("c.dp_cost").alias("dp_cost"), "error")


def corrected(selections: DataFrame, fixes: DataFrame) -> DataFrame:
    """Selections with the faultless corrections in place of what was chosen."""
    good = fixes.where("error IS NULL").select("pair_id", "corrected_ops_json", "candidate_rank", "dp_cost")
    j = selections.join(good, "pair_id", "left")
    own = F.col("corrected_ops_json").isNotNull()
    return j.select(
        "pair_id", "t", F.when(own, F.col("candidate_rank")).otherwise(F.col("chosen_idx")).alias("chosen_idx"), F.when(own, F.col("dp_cost")).otherwise(F.col("chosen_score")).alias("chosen_score"),
        F.coalesce("corrected_ops_json", "chosen_ops_json").alias("chosen_ops_json"), own.alias("corrected"),
    )


def cost_above_best(candidates: DataFrame) -> DataFrame:
    """candidates plus dp_cost_delta, the cost above the pair's least."""
    least = candidates.groupBy("pair_id").agg(F.min("dp_cost").alias("_least"))
    return candidates.join(least, "pair_id").withColumn("dp_cost_delta", F.col("dp_cost") - F.col("_least")).drop("_least")


def dendrogram(tree: DataFrame) -> DataFrame:
    """(dataset_id, track_id, depth, place) of `hierarchy.paths`: leaves side by side in the order of their paths, each track in the middle of
    its outermost leaves; tracks without a root are left out."""
    rooted = tree.where("path IS NOT NULL").select("dataset_id", F.col("node").alias("track_id"), "depth", "path")
    mothers = tree.where("parent IS NOT NULL").select("dataset_id", F.col("parent").alias("track_id")).distinct()
    leaves = with_positions(rooted.join(mothers, KEY, "left_anti"), ["dataset_id"], [F.col("path")], "rank")
    above = leaves.select("dataset_id", F.explode("path").alias("track_id"), "rank").groupBy(*KEY).agg(((F.min("rank") + F.max("rank")) / 2).alias("place"))
    return rooted.select(*KEY, "depth").join(above, KEY)
