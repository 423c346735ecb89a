"""Queries over tracks and gt_divisions as frames of cells: true operations, costs, features, candidates, lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.costs import TrackerParams
from cellweave.operators import tracking as trk
from cellweave.plans.candidates import OPS_KEY, OPS_LIST, _rounded
from cellweave.plans.lineage import _divisions, _manifest, _tracks
from cellweave.session import stored, table

PARAMS = TrackerParams()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks' rows as the cells of their frames; a label that stands twice in a frame is the first of its tracks."""
    rows = _tracks(spark, sf_dir).where("y IS NOT NULL AND area > 0")
    first = rows.groupBy("dataset_id", "t", "label").agg(F.min(F.struct("track_id", "x", "y", "area", "axis_len")).alias("c"))
    return first.select("dataset_id", "t", "label", F.col("c.track_id").alias("track_id"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.area").alias("area"), F.col("c.axis_len").alias("length"), F.lit(False).alias("border"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk.true_operations(_cells(spark, sf_dir), _divisions(spark, sf_dir), _manifest(spark, sf_dir))


def gt_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _truth(spark, sf_dir).select("dataset_id", "t", F.explode("ops").alias("o"))
    return o.select("dataset_id", "t", "o.kind", "o.src", "o.dst1", "o.dst2")


def gt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates of scored agree with the truth of the tracks, and how many pairs lack it."""
    c = table(spark, sf_dir, "scored").where("pair_id IS NOT NULL").select("pair_id", "sample_rank", "ops_json").distinct()
    marked = trk.mark_correct(c, _truth(spark, sf_dir))
    return marked.groupBy("pair_id").agg(F.count("*").alias("n_candidates"), F.bool_or("is_correct").alias("has_truth"))


def op_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trk.operation_costs(_truth(spark, sf_dir), _cells(spark, sf_dir), PARAMS))


def op_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    out = trk.operation_features(_truth(spark, sf_dir), cells, cells.groupBy("dataset_id").agg(F.max("y").alias("height")))
    return _rounded(out.drop("exit_open_end_dist_median_norm", "total_area_ratio_exit_adjusted"))


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every candidate of every pair of frames, at the number of candidates that production makes."""
    cells = _cells(spark, sf_dir)
    heights = cells.groupBy("dataset_id").agg(F.max("y").alias("height")).join(_manifest(spark, sf_dir).select("dataset_id", "open_end"), "dataset_id", "left")
    made = stored(trk.generate_candidates(trk.frame_pairs(trk.frame_arrays(cells, PARAMS)), PARAMS).select("dataset_id", "t", "delta_t", "pair_id", "sample_rank", "ops"))
    return _rounded(trk.operation_features(made, cells, heights))


def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trk.frame_pairs(trk.frame_arrays(_cells(spark, sf_dir), PARAMS))
    return trk.generate_candidates(pairs, PARAMS).select("dataset_id", "pair_id", "t", "sample_rank", "dp_cost", "n_candidates_pair", "ops_json")


def lineage_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from the true operations of the frames."""
    arrays = trk.frame_arrays(_cells(spark, sf_dir), PARAMS)
    return trk.reconstruct(_truth(spark, sf_dir), arrays)[0]


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of scored that would bridge its most doubtful pairs."""
    scored = table(spark, sf_dir, "scored").where("pair_id IS NOT NULL AND dataset_id IS NOT NULL").select("dataset_id", "pair_id", "t", "delta_t", "candidate_correctness_probability").distinct()
    p = F.max(F.when(~F.isnan("candidate_correctness_probability"), F.col("candidate_correctness_probability")))
    best = scored.groupBy("dataset_id", "t", "delta_t").agg(p.alias("score"))
    drops = best.where("delta_t = 1 AND score < 0.8").select("dataset_id", "t", F.lit("DROP").alias("action"), F.lit("ANOMALY").alias("drop_reason"))
    return _rounded(trk.bridge_spans(drops, best.select("dataset_id", F.col("t").alias("t_a"), (F.col("t") + F.col("delta_t")).alias("t_b"), "score"), tau=0.5, max_gap=3))


QUERIES = {f.__name__: f for f in (gt_ops, gt_matches, op_costs, op_features, candidate_features, candidates_topk, lineage_reconstruct, bridges)}

_O = """WITH tr AS (SELECT DISTINCT dataset_id, track_id, t, label, y, area FROM tracks WHERE NOT isnan(y) AND area > 0 AND dataset_id IS NOT NULL AND track_id IS NOT NULL AND t IS NOT NULL),
c AS (SELECT dataset_id, t, label, track_id, y, area FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, t, label ORDER BY track_id) AS k FROM tr) WHERE k = 1),
dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, mother_track_id ORDER BY t_div NULLS FIRST, d1_track_id NULLS FIRST, d2_track_id NULLS FIRST) AS k FROM gt_divisions WHERE mother_track_id >= 1) WHERE k = 1),
nx AS (SELECT dataset_id, t - 1 AS t, track_id, min(label) AS label FROM c GROUP BY ALL),
j AS (SELECT c.*, nx.label AS n, a.label AS l1, b.label AS l2 FROM c LEFT JOIN nx ON c.dataset_id = nx.dataset_id AND c.t = nx.t AND c.track_id = nx.track_id
  LEFT JOIN dv ON c.dataset_id = dv.dataset_id AND c.track_id = dv.mother_track_id AND c.t = dv.t_div
  LEFT JOIN nx a ON c.dataset_id = a.dataset_id AND c.t = a.t AND dv.d1_track_id = a.track_id LEFT JOIN nx b ON c.dataset_id = b.dataset_id AND c.t = b.t AND dv.d2_track_id = b.track_id),
o AS (SELECT dataset_id, t, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN 'divide' WHEN n IS NOT NULL THEN 'link' ELSE 'exit' END AS kind, label AS src,
    CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN l1 ELSE n END AS dst1, CASE WHEN l1 IS NOT NULL THEN l2 END AS dst2 FROM j),
w AS (SELECT o.*, s.y AS ys, s.area AS s, a.y AS ya, a.area AS a, b.y AS yb, b.area AS b FROM o JOIN c s ON o.dataset_id = s.dataset_id AND o.t = s.t AND o.src = s.label
  LEFT JOIN c a ON o.dataset_id = a.dataset_id AND o.t = a.t - 1 AND o.dst1 = a.label LEFT JOIN c b ON o.dataset_id = b.dataset_id AND o.t = b.t - 1 AND o.dst2 = b.label)
"""


def _f(x: str) -> str:
    return f"CAST(CAST(round({x}, 12) AS FLOAT) AS DOUBLE)"


def _shrunk(x: str) -> str:
    return f"greatest(0, 1 - ({x} + 1e-9) / (s + 1e-9) - 0.05)"


def _ratio(x: str, y: str) -> str:
    return f"greatest({x}, {y}) / greatest(least({x}, {y}), 1e-9)"


_LINK = f"0.02 * abs(ys - ya) + 0.2 * abs(ln((s + 1e-9) / (a + 1e-9))) + 50 * {_shrunk('a')}"
_DIVIDE = f"0.1 + 0.02 * (abs(ys - ya) + abs(ys - yb)) + 0.2 * abs(s - (a + b)) / greatest(s, 1) + 2 * abs(a - b) / (a + b + 1e-9) - 10 * ({_shrunk('a')} + {_shrunk('b')})"

SQL = {
    "gt_matches": _O
    + f"""SELECT pair_id, count(*) AS n_candidates, bool_or(key = own) AS has_truth FROM (
  SELECT s.pair_id, {OPS_KEY.format(o="o")} AS key, g.own FROM (SELECT DISTINCT pair_id, sample_rank, {OPS_LIST} AS o FROM scored WHERE pair_id IS NOT NULL) s LEFT JOIN (
    SELECT dataset_id || ':' || t || '->' || (t + 1) AS pair_id, {OPS_KEY.format(o="list([kind, src::VARCHAR, CASE WHEN kind <> 'exit' THEN dst1::VARCHAR END, CASE WHEN kind = 'divide' THEN dst2::VARCHAR END])")} AS own FROM o GROUP BY dataset_id, t) g
  ON s.pair_id = g.pair_id) GROUP BY pair_id""",
    "gt_ops": _O + "SELECT dataset_id, t, kind, src, CASE WHEN kind <> 'exit' THEN dst1 END AS dst1, CASE WHEN kind = 'divide' THEN dst2 END AS dst2 FROM o",
    "op_costs": _O + f"SELECT dataset_id, t, kind, src, {_f(f'CASE WHEN kind = $$link$$ THEN {_LINK} ELSE {_DIVIDE} END')} AS cost FROM w WHERE kind <> 'exit'".replace("$$", "'"),
    "op_features": _O
    + f""", h AS (SELECT dataset_id, max(y) AS h FROM c GROUP BY ALL),
v AS (SELECT w.dataset_id, w.t, CASE WHEN kind = 'link' THEN {_ratio("s", "a")} END AS lr, CASE WHEN kind = 'link' THEN abs(ya - ys) / h END AS ld, CASE WHEN kind = 'divide' THEN {_ratio("s", "a + b")} END AS mr,
  CASE WHEN kind = 'divide' THEN {_ratio("a", "b")} END AS dr, CASE WHEN kind = 'divide' THEN abs(ya - ys) / h END AS d1, CASE WHEN kind = 'divide' THEN abs(yb - ys) / h END AS d2,
  CASE WHEN kind = 'link' THEN 100 * greatest(0, 1 - (a + 1e-9) / (s + 1e-9)) END AS sh FROM w JOIN h USING (dataset_id))
SELECT dataset_id, t, dataset_id || ':' || t || '->' || (t + 1) AS pair_id, {_f("coalesce(max(sh), 0)")} AS max_shrink_pct, {_f("median(lr)")} AS link_area_ratio_median, {_f("max(lr)")} AS link_area_ratio_max,
  {_f("median(ld)")} AS link_dy_median_norm, {_f("max(ld)")} AS link_dy_max_norm, {_f("max(mr)")} AS div_mother_sum_area_ratio_max, {_f("avg(mr)")} AS div_mother_sum_area_ratio_mean, {_f("max(dr)")} AS div_daughter_area_ratio_max,
  {_f("avg(dr)")} AS div_daughter_area_ratio_mean, {_f("max(greatest(d1, d2))")} AS div_mother_daughter_dy_max_norm, {_f("sum(d1 + d2) / (2 * count(d1))")} AS div_mother_daughter_dy_mean_norm
FROM v GROUP BY dataset_id, t""",
    "bridges": f"""WITH s AS (SELECT DISTINCT dataset_id, pair_id, t, delta_t, candidate_correctness_probability AS p FROM scored WHERE pair_id IS NOT NULL AND dataset_id IS NOT NULL),
b AS (SELECT dataset_id, t, delta_t, max(CASE WHEN NOT isnan(p) THEN p END) AS score FROM s GROUP BY ALL),
d AS (SELECT DISTINCT dataset_id, t AS t_drop FROM b WHERE delta_t = 1 AND score < 0.8),
x AS (SELECT d.dataset_id, t_drop, b.t AS t_a, b.t + delta_t AS t_b, score, row_number() OVER (PARTITION BY d.dataset_id, t_drop ORDER BY delta_t, score DESC, b.t) AS k
  FROM d JOIN b ON d.dataset_id = b.dataset_id AND b.t <= t_drop AND t_drop < b.t + delta_t WHERE delta_t BETWEEN 2 AND 3 AND score >= 0.5)
SELECT dataset_id, t_drop, t_a, t_b, {_f("score")} AS score FROM x WHERE k = 1""",
}
