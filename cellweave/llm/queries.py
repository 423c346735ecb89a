"""The queries of the training-data problems tagged llm, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import mix, pii, quantiles, splits, tokens, topn
from cellweave.session import Stored, table

FEATURES = ("link_area_ratio_median", "max_shrink_pct")


def _shares(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """The wanted shares of split_shares, a table of parameters with a row per split."""
    rows = table(spark, sf_dir, "split_shares").groupBy("split_name").agg(F.max("share").alias("share")).where("split_name IS NOT NULL").collect()
    return [(r["split_name"], r["share"]) for r in rows]


def p1_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.radix_quantiles(table(spark, sf_dir, "scored"), "dataset_id", FEATURES)
    return out.select("dataset_id", "column_name", "pct", "value", "rank", "n")


def p1_merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.radix_quantiles(table(spark, sf_dir, "scored"), "dataset_id", FEATURES, part="labels_dir")
    return out.select("dataset_id", "column_name", "pct", "value", "rank", "n")


def p1_summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from stored summaries of the parts alone."""
    kept = Stored(quantiles.summarise(table(spark, sf_dir, "scored"), "dataset_id", FEATURES, "labels_dir")).df
    return quantiles.merged_quantiles(kept).withColumnRenamed("grp", "dataset_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_candidates(table(spark, sf_dir, "scored")).select("pair_id", "sample_rank")


def p5_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_candidates(table(spark, sf_dir, "scored")).select("pair_id", "sample_rank", F.col("position").cast("bigint").alias("position"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.joined_pairs(table(spark, sf_dir, "scored"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "scored").select("dataset_id", "pair_id", "sample_rank", "labels_dir", "t")
    return splits.split_records(records, _shares(spark, sf_dir)).select("dataset_id", "pair_id", "sample_rank", "split_name")


def p6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset_id with the least one it is joined to."""
    return splits.entity_components(table(spark, sf_dir, "scored")).select(F.col("entity").alias("dataset_id"), "component")


def p6_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of dataset_id and of pair_id have rows in more than one split, and how many rows have none."""
    out = Stored(p6_splits(spark, sf_dir)).df
    parted = [out.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("split_name").alias("k")).select(F.lit(c).alias("what"), (F.col("k") > 1).cast("int").alias("bad")) for c in ("dataset_id", "pair_id")]
    none = out.select(F.lit("row").alias("what"), F.col("split_name").isNull().cast("int").alias("bad"))
    return parted[0].union(parted[1]).union(none).groupBy("what").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps to its target: its share of the sources that have tokens to within one in a hundred, its repeats within max_repeats."""
    targets = table(spark, sf_dir, "mix_targets")
    shares = Stored(mix.mix_documents(table(spark, sf_dir, "documents"), targets)[1]).df
    whole = shares.where("n_tokens > 0").agg(F.sum("target_share").alias("w"))
    limit = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    judged = shares.crossJoin(F.broadcast(whole)).join(limit, "source")
    near = (F.col("n_tokens") == 0) | (F.abs(F.col("share") - F.col("target_share") / F.col("w")) < 0.01)
    return judged.select("source", (F.col("n_tokens") > 0).alias("has_tokens"), near.alias("near_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_values(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), with_text=True).select("doc_id", F.col("redacted").alias("text"))


def p9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), secret="example secret")


QUERIES = {f.__name__: f for f in (p1_quantiles, p1_merged_quantiles, p1_summary_quantiles, p5_found, p5_top3, p6_found, p6_components, p6_splits, p6_parted, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_redacted, p9_surrogates)}

_VALUES = """
WITH v AS (
  SELECT dataset_id, unnest(['link_area_ratio_median', 'max_shrink_pct']) AS column_name, unnest([link_area_ratio_median, max_shrink_pct]) AS value
  FROM scored),
r AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY value) AS rank, count(*) OVER (PARTITION BY dataset_id, column_name) AS n
  FROM v WHERE value IS NOT NULL AND NOT isnan(value))
SELECT dataset_id, column_name, CAST(pct AS DOUBLE) AS pct, value, rank, n
FROM r, (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS pct) p
WHERE rank = greatest(1, (n * pct + 99) // 100)
"""

_TOP = """
WITH d AS (
  SELECT DISTINCT pair_id, sample_rank, raw_score, dp_cost FROM scored
  WHERE pair_id IS NOT NULL AND raw_score IS NOT NULL AND isfinite(raw_score)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY raw_score DESC, dp_cost ASC NULLS LAST, sample_rank) AS position FROM d)
SELECT pair_id, sample_rank{more} FROM r WHERE position <= 3
"""

_JOINED = """
WITH RECURSIVE l AS (
  SELECT DISTINCT a.dataset_id AS a, b.dataset_id AS b
  FROM (SELECT DISTINCT dataset_id, pair_id FROM scored) a JOIN (SELECT DISTINCT dataset_id, pair_id FROM scored) b USING (pair_id)
  WHERE a.dataset_id <> b.dataset_id),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
"""

SQL = {
    "p1_quantiles": _VALUES,
    "p1_merged_quantiles": _VALUES,
    "p5_found": _TOP.format(more=""),
    "p5_top3": _TOP.format(more=", position"),
    "p8_bounds": """
SELECT t.source, count(d.doc_id) > 0 AS has_tokens, TRUE AS near_target, TRUE AS within_repeats
FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL AND target_share > 0) t LEFT JOIN (SELECT * FROM documents WHERE length(text) > 0) d ON t.source = d.source GROUP BY t.source""",
    "p6_parted": """
SELECT 'dataset_id' AS what, count(DISTINCT dataset_id) AS n, 0::BIGINT AS n_bad FROM scored UNION ALL SELECT 'pair_id', count(DISTINCT pair_id), 0 FROM scored UNION ALL SELECT 'row', count(*), 0 FROM scored""",
    "p6_components": _JOINED + "SELECT d.dataset_id, least(d.dataset_id, coalesce(min(c.b), d.dataset_id)) AS component FROM (SELECT DISTINCT dataset_id FROM scored WHERE dataset_id IS NOT NULL) d LEFT JOIN c ON d.dataset_id = c.a GROUP BY d.dataset_id",
    "p6_found": _JOINED + "SELECT a AS dataset_id_a, b AS dataset_id_b FROM c WHERE a < b",
}
