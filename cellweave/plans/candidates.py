"""Queries over scored: probabilities, selection, per-pair summaries, decisions, operation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import selection as sel
from cellweave.operators import tracking as trk
from cellweave.schemas import FEATURES, value
from cellweave.session import stored, table


def _candidates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return sel.candidates(table(spark, sf_dir, "scored"), *columns)


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "t", "dp_cost", "raw_score", "ops_json")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles in single precision, so that sums in another order compare as equal."""
    return df.select(*[F.round(c, 12).cast("float").cast("double").alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def select_dp_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(_choice(spark, sf_dir), "dp_cost_min")


def select_classifier_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(_choice(spark, sf_dir), "classifier")


def ensemble_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(_choice(spark, sf_dir), "ensemble_rank", alpha=0.5)


def ensemble_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.select(_choice(spark, sf_dir), "ensemble_zscore", alpha=0.5))


def pair_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.pair_probabilities(_candidates(spark, sf_dir, "raw_score")).select("pair_id", "sample_rank", "pair_probability", "score_rank"))


def uniform_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.uniform_prior(_candidates(spark, sf_dir)))


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "dataset_id", "t", "dp_cost", "raw_score", "pair_probability", *FEATURES)


def per_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.per_pair_features(_featured(spark, sf_dir)))


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.pair_diagnostics(_candidates(spark, sf_dir, "dataset_id", "t", "dp_cost", "raw_score", "pair_probability", "is_correct"))


def pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diagnosed(spark, sf_dir))


def qa_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = sel.decide(_diagnosed(spark, sf_dir), sel.select_dp(_choice(spark, sf_dir)), disagreement="soft", soft_threshold=0.5)
    return decided.select("pair_id", "t", "action", "drop_reason", "chosen_idx", "chosen_ops_json")


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.rule_flags(_candidates(spark, sf_dir, "max_shrink_pct", "total_area_ratio_exit_adjusted", "dp_cost")).drop("max_shrink_pct", "total_area_ratio_exit_adjusted", "dp_cost")


def ops_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.parsed(_candidates(spark, sf_dir, "ops_json"))


def ops_first_of_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.first_of_equals(_candidates(spark, sf_dir, "ops_json"))


def qa_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of scored whose best candidate is doubtful dropped, and bridged by its spans over more frames."""
    rows = table(spark, sf_dir, "scored").where("pair_id IS NOT NULL AND dataset_id IS NOT NULL").select("dataset_id", "t", "delta_t", "ops_json", value("candidate_correctness_probability").alias("p"))
    best = stored(rows.groupBy("dataset_id", "t", "delta_t").agg(F.max("p").alias("score"), F.max(F.when(F.col("p").isNotNull(), F.struct("p", "ops_json")))["ops_json"].alias("ops_json")))
    dropped = F.coalesce(F.col("score") < 0.8, F.lit(False))
    decisions = best.where("delta_t = 1").select("dataset_id", "t", F.when(dropped, "DROP").otherwise("KEEP").alias("action"), F.when(dropped, "ANOMALY").alias("drop_reason"))
    spans = best.select("dataset_id", F.col("t").alias("t_a"), (F.col("t") + F.col("delta_t")).alias("t_b"), "score", "ops_json")
    return _rounded(trk.bridge_drops(decisions, spans, tau=0.5, max_gap=3))


QUERIES = {
    f.__name__: f
    for f in (qa_bridged, select_dp_min, select_classifier_max, ensemble_rank, ensemble_zscore, pair_softmax, uniform_prior, per_pair_features, pair_diagnostics, qa_decisions, rule_flags, ops_parsed, ops_first_of_equals)
}

_C = "WITH c AS (SELECT DISTINCT pair_id, sample_rank{columns} FROM scored WHERE pair_id IS NOT NULL)"


def _c(*columns: str) -> str:
    return _C.format(columns="".join(f", CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c in _DOUBLES else f", {c}" for c in columns))


_DOUBLES = {"dp_cost", "raw_score", "pair_probability", *FEATURES}
_CHOICE = _c("t", "dp_cost", "raw_score", "ops_json")
_PICK = """, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY {order}) AS k FROM c WHERE {known})
SELECT pair_id, t, sample_rank AS chosen_idx, {score} AS chosen_score, ops_json AS chosen_ops_json FROM r WHERE k = 1"""
_FINITE = "(raw_score IS NOT NULL AND isfinite(raw_score))"


def _best_of(order: str, known: str, name: str, columns: str) -> str:
    return f"{name} AS (SELECT pair_id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY {order}) AS k FROM c WHERE {known}) WHERE k = 1)"


def _features_sql() -> str:
    aggs = []
    for f in FEATURES:
        v = f"CASE WHEN isfinite({f}) THEN {f} END"
        aggs += [f"CAST(CAST(round(max({v}), 12) AS FLOAT) AS DOUBLE) AS {f}_max", f"CAST(CAST(round(min({v}), 12) AS FLOAT) AS DOUBLE) AS {f}_min", f"CAST(CAST(round(avg({v}), 12) AS FLOAT) AS DOUBLE) AS {f}_mean", f"CAST(CAST(round(stddev_pop({v}), 12) AS FLOAT) AS DOUBLE) AS {f}_std"]
    s, d, p = (f"CASE WHEN isfinite({x}) THEN {x} END" for x in ("raw_score", "dp_cost", "pair_probability"))
    aggs += [
        f"CAST(CAST(round(max({s}), 12) AS FLOAT) AS DOUBLE) AS score_max", f"CAST(CAST(round(min({s}), 12) AS FLOAT) AS DOUBLE) AS score_min", f"CAST(CAST(round(avg({s}), 12) AS FLOAT) AS DOUBLE) AS score_mean", f"CAST(CAST(round(stddev_pop({s}), 12) AS FLOAT) AS DOUBLE) AS score_std",
        f"CAST(CAST(round(ln(sum({p})) - sum(CASE WHEN {p} > 0 THEN {p} * ln({p}) END) / sum({p}), 12) AS FLOAT) AS DOUBLE) AS score_entropy", f"CAST(CAST(round(max({p}), 12) AS FLOAT) AS DOUBLE) AS score_max_pair_probability",
        f"CAST(CAST(round(min({d}), 12) AS FLOAT) AS DOUBLE) AS dp_cost_min", f"CAST(CAST(round(max({d}), 12) AS FLOAT) AS DOUBLE) AS dp_cost_max", f"CAST(CAST(round(avg({d}), 12) AS FLOAT) AS DOUBLE) AS dp_cost_mean", f"CAST(CAST(round(max({d}) - min({d}), 12) AS FLOAT) AS DOUBLE) AS dp_cost_range",
        "min(dataset_id) AS dataset_id", "min(t) AS t", "CAST(count(*) AS INTEGER) AS n_candidates",
    ]
    best = ", ".join(f"CAST(CAST(round({f}, 12) AS FLOAT) AS DOUBLE) AS {f}_best" for f in FEATURES)
    return (
        _c("dataset_id", "t", *sorted(_DOUBLES))
        + f", g AS (SELECT pair_id, {', '.join(aggs)} FROM c GROUP BY pair_id), "
        + _best_of("raw_score IS NULL, coalesce(raw_score, -dp_cost) DESC NULLS LAST, sample_rank", "TRUE", "b", best)
        + ", s AS (SELECT pair_id, CAST(CAST(round(max(CASE WHEN k = 1 THEN raw_score END) - max(CASE WHEN k = 2 THEN raw_score END), 12) AS FLOAT) AS DOUBLE) AS score_margin_top1_top2 FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY raw_score DESC, sample_rank) AS k"
        + f" FROM c WHERE {_FINITE}) GROUP BY pair_id), "
        + _GAPS
        + " SELECT g.*, b.* EXCLUDE (pair_id), s.score_margin_top1_top2, CASE WHEN complete THEN CAST(CAST(round(sqrt(norm * score_gap), 12) AS FLOAT) AS DOUBLE) END AS disagreement_score"
        + " FROM g LEFT JOIN b USING (pair_id) LEFT JOIN s USING (pair_id) LEFT JOIN gaps USING (pair_id)"
    )


_GAPS = (
    _best_of("dp_cost, sample_rank", "dp_cost IS NOT NULL", "dp", "sample_rank AS dr, dp_cost AS dc, raw_score AS ds")
    + ", "
    + _best_of("raw_score DESC, sample_rank", "raw_score IS NOT NULL", "cls", "sample_rank AS cr, dp_cost AS cc, raw_score AS cs")
    + ", gaps AS (SELECT pair_id, dr, cr, dc IS NOT NULL AND cc IS NOT NULL AND ds IS NOT NULL AND cs IS NOT NULL AS complete, greatest(cc - dc, 0) AS gap, greatest(cc - dc, 0) / greatest(abs(dc), 1e-9) AS norm,"
    + " greatest(cs - ds, 0) AS score_gap FROM (SELECT DISTINCT pair_id FROM c) LEFT JOIN dp USING (pair_id) LEFT JOIN cls USING (pair_id))"
)
_DIAGNOSED = _c("dataset_id", "t", "dp_cost", "raw_score", "pair_probability", "is_correct", "ops_json") + ", " + _GAPS

# operation lists as lists of texts, and the key that is equal for lists that differ in order only
OPS_LIST = "CAST(ops_json AS JSON)::VARCHAR[][]"
OPS_KEY = """array_to_string(list_transform(list_sort(list_transform({o}, lambda x: CASE WHEN x[1] = 'divide' AND coalesce(x[3]::INT, -1) > coalesce(x[4]::INT, -1)
  THEN {{'s': x[2]::INT, 'k': x[1], 'a': coalesce(x[4]::INT, -1), 'b': coalesce(x[3]::INT, -1)}} ELSE {{'s': x[2]::INT, 'k': x[1], 'a': coalesce(x[3]::INT, -1), 'b': coalesce(x[4]::INT, -1)}} END)),
  lambda y: y.s || ':' || y.k || ':' || y.a || ':' || y.b), '|')"""
_GIVEN = "(CASE WHEN x[3] IS NULL THEN 0 ELSE 1 END + CASE WHEN x[4] IS NULL THEN 0 ELSE 1 END)"
_PARSED = (
    _c("ops_json")
    + f""", q AS (SELECT pair_id, sample_rank, {OPS_LIST} AS o FROM c),
f AS (SELECT *, list_transform(o, lambda x: x[2]) AS src, list_filter(flatten(list_transform(o, lambda x: [x[3], x[4]])), lambda d: d IS NOT NULL) AS dst, CAST(len(list_filter(o, lambda x: x[1] = 'exit')) AS INTEGER) AS exits FROM q),
p AS (SELECT pair_id, sample_rank, CAST(len(list_filter(o, lambda x: x[1] = 'link')) AS INTEGER) AS links, CAST(len(list_filter(o, lambda x: x[1] = 'divide')) AS INTEGER) AS divides, exits, {OPS_KEY.format(o="o")} AS canonical_key,
  coalesce(array_to_string(list_reverse(list_transform(o, lambda x: x[1][1])), ''), '') AS compact,
  CASE WHEN o IS NULL THEN 'not a list of operations' WHEN len(list_filter(o, lambda x: coalesce(x[1], '') NOT IN ('link', 'divide', 'exit'))) > 0 THEN 'unknown kind' WHEN len(list_filter(src, lambda s: s IS NULL)) > 0 THEN 'no source'
    WHEN len(list_filter(o, lambda x: {_GIVEN} <> CASE x[1] WHEN 'link' THEN 1 WHEN 'divide' THEN 2 ELSE 0 END)) > 0 THEN 'wrong number of destinations'
    WHEN len(list_distinct(src)) < len(o) THEN 'source used twice' WHEN len(list_distinct(dst)) < len(dst) THEN 'destination used twice'
    WHEN len(list_filter(o[1:exits], lambda x: x[1] <> 'exit')) > 0 THEN 'exit after another operation' END AS error
  FROM f)
"""
)

SQL = {
    "ops_parsed": _PARSED + "SELECT * FROM p",
    "ops_first_of_equals": _PARSED + "SELECT pair_id, canonical_key, min(sample_rank) AS sample_rank FROM p GROUP BY ALL",
    "qa_bridged": """WITH RECURSIVE s AS (SELECT dataset_id, t, delta_t, ops_json, CASE WHEN NOT isnan(candidate_correctness_probability) THEN candidate_correctness_probability END AS p
  FROM scored WHERE pair_id IS NOT NULL AND dataset_id IS NOT NULL),
b AS (SELECT dataset_id, t, delta_t, max(p) AS score FROM s GROUP BY ALL), m AS (SELECT dataset_id, t, delta_t, p, max(ops_json) AS ops_json FROM s WHERE p IS NOT NULL GROUP BY ALL),
d AS (SELECT dataset_id, t, coalesce(score < 0.8, FALSE) AS gone FROM b WHERE delta_t = 1),
x AS (SELECT d.dataset_id, d.t AS t_drop, b.t AS t_a, b.t + b.delta_t AS t_b, score, row_number() OVER (PARTITION BY d.dataset_id, d.t ORDER BY b.delta_t, score DESC, b.t) AS k
  FROM d JOIN b ON d.dataset_id = b.dataset_id AND b.t <= d.t AND d.t < b.t + b.delta_t WHERE gone AND b.delta_t BETWEEN 2 AND 3 AND score >= 0.5),
y AS (SELECT x.*, m.ops_json FROM x LEFT JOIN m ON x.dataset_id = m.dataset_id AND x.t_a = m.t AND x.t_b = m.t + m.delta_t AND x.score = m.p WHERE k = 1),
n AS (SELECT d.dataset_id, d.t, min(e.t) AS nt FROM d LEFT JOIN y ON d.dataset_id = y.dataset_id AND d.t = y.t_drop JOIN d e ON d.dataset_id = e.dataset_id AND e.gone AND e.t >= greatest(coalesce(y.t_b, 0), d.t + 1) WHERE d.gone GROUP BY ALL),
w(dataset_id, t) AS (SELECT dataset_id, min(t) FROM d WHERE gone GROUP BY dataset_id UNION ALL SELECT n.dataset_id, n.nt FROM w JOIN n ON w.dataset_id = n.dataset_id AND w.t = n.t),
a AS (SELECT y.dataset_id, y.t_a, min(y.t_drop) AS f, max(y.t_drop) AS l FROM w JOIN y ON w.dataset_id = y.dataset_id AND w.t = y.t_drop GROUP BY ALL),
z AS (SELECT a.dataset_id, a.t_a, a.f, y.t_b, y.score, y.ops_json FROM a JOIN y ON a.dataset_id = y.dataset_id AND a.l = y.t_drop),
c AS (SELECT d.dataset_id, d.t, d.gone, z.*EXCLUDE (dataset_id), row_number() OVER (PARTITION BY d.dataset_id, d.t ORDER BY z.f, z.t_a) AS k FROM d LEFT JOIN z ON d.dataset_id = z.dataset_id AND z.t_a <= d.t AND d.t < z.t_b)
SELECT dataset_id, t, CASE WHEN t_a IS NOT NULL THEN 'BRIDGE' WHEN gone THEN 'DROP' ELSE 'KEEP' END AS action, CASE WHEN t_a IS NULL AND gone THEN 'BRIDGE_FAILED' END AS drop_reason, t_a AS bridge_t_a, t_b AS bridge_t_b,
  CAST(CAST(round(score, 12) AS FLOAT) AS DOUBLE) AS bridge_score, CASE WHEN t = t_a THEN ops_json END AS bridge_ops_json, coalesce(t = t_a, FALSE) AS bridge_is_primary FROM c WHERE k = 1""",
    "select_dp_min": _CHOICE + _PICK.format(order="dp_cost, sample_rank", known="dp_cost IS NOT NULL", score="dp_cost"),
    "select_classifier_max": _CHOICE + _PICK.format(order="raw_score DESC, sample_rank", known="raw_score IS NOT NULL", score="raw_score"),
    "ensemble_rank": _CHOICE
    + f""", q AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY dp_cost, sample_rank) AS d, row_number() OVER (PARTITION BY pair_id ORDER BY raw_score DESC, sample_rank) AS s
  FROM c WHERE dp_cost IS NOT NULL AND {_FINITE}),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY 0.5 * d + 0.5 * s, d) AS k FROM q)
SELECT pair_id, t, sample_rank AS chosen_idx, CAST(0.5 * d + 0.5 * s AS DOUBLE) AS chosen_score, ops_json AS chosen_ops_json FROM r WHERE k = 1""",
    "ensemble_zscore": _CHOICE
    + f""", q AS (SELECT *, avg(dp_cost) OVER p AS md, stddev_pop(dp_cost) OVER p AS sd, avg(raw_score) OVER p AS mc, stddev_pop(raw_score) OVER p AS sc
  FROM c WHERE dp_cost IS NOT NULL AND {_FINITE} WINDOW p AS (PARTITION BY pair_id)),
m AS (SELECT *, round(0.5 * CASE WHEN sd > 0 THEN (md - dp_cost) / sd ELSE 0 END + 0.5 * CASE WHEN sc > 0 THEN (raw_score - mc) / sc ELSE 0 END, 9) AS mixed FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY mixed DESC, sample_rank) AS k FROM m)
SELECT pair_id, t, sample_rank AS chosen_idx, CAST(CAST(round(mixed, 12) AS FLOAT) AS DOUBLE) AS chosen_score, ops_json AS chosen_ops_json FROM r WHERE k = 1""",
    "pair_softmax": _c("raw_score")
    + f""", f AS (SELECT *, exp(raw_score - max(raw_score) OVER (PARTITION BY pair_id)) AS e, row_number() OVER (PARTITION BY pair_id ORDER BY raw_score DESC, sample_rank) AS k FROM c WHERE {_FINITE})
SELECT c.pair_id, c.sample_rank, CAST(CAST(round(e / sum(e) OVER (PARTITION BY c.pair_id), 12) AS FLOAT) AS DOUBLE) AS pair_probability, CAST(k AS DOUBLE) AS score_rank
FROM c LEFT JOIN f ON c.pair_id = f.pair_id AND c.sample_rank = f.sample_rank""",
    "uniform_prior": _c() + " SELECT pair_id, sample_rank, CAST(CAST(round(1.0 / count(*) OVER (PARTITION BY pair_id), 12) AS FLOAT) AS DOUBLE)::DOUBLE AS prior FROM c",
    "per_pair_features": _features_sql(),
    "pair_diagnostics": _DIAGNOSED
    + """, g AS (SELECT pair_id, min(dataset_id) AS dataset_id, min(t) AS t, CAST(count(*) AS INTEGER) AS n_candidates, CAST(CAST(round(max(CASE WHEN isfinite(raw_score) THEN raw_score END), 12) AS FLOAT) AS DOUBLE) AS within_pair_max_score,
  CAST(CAST(round(-sum(CASE WHEN pair_probability > 0 AND isfinite(pair_probability) THEN pair_probability * ln(pair_probability) END), 12) AS FLOAT) AS DOUBLE) AS within_pair_entropy, bool_or(is_correct) AS has_correct_candidate FROM c GROUP BY pair_id)
SELECT g.*, dr AS dp_top1_idx, cr AS classifier_top1_idx, coalesce(dr <> cr, FALSE) AS classifier_disagrees_with_dp, CASE WHEN complete THEN CAST(CAST(round(gap, 12) AS FLOAT) AS DOUBLE) END AS dp_cost_gap,
  CASE WHEN complete THEN CAST(CAST(round(norm, 12) AS FLOAT) AS DOUBLE) END AS dp_cost_gap_normalised, CASE WHEN complete THEN CAST(CAST(round(score_gap, 12) AS FLOAT) AS DOUBLE) END AS classifier_score_gap, CASE WHEN complete THEN CAST(CAST(round(sqrt(norm * score_gap), 12) AS FLOAT) AS DOUBLE) END AS disagreement_score
FROM g JOIN gaps USING (pair_id)""",
    "qa_decisions": _DIAGNOSED
    + """, a AS (SELECT pair_id, dr, complete AND isfinite(sqrt(norm * score_gap)) AND sqrt(norm * score_gap) > 0.5 AS dropped FROM gaps), m AS (SELECT pair_id, min(t) AS t FROM c GROUP BY pair_id)
SELECT a.pair_id, m.t, CASE WHEN dropped THEN 'DROP' ELSE 'KEEP' END AS action, CASE WHEN dropped THEN 'DISAGREEMENT' END AS drop_reason, CASE WHEN NOT dropped THEN dr END AS chosen_idx,
  CASE WHEN NOT dropped THEN c.ops_json END AS chosen_ops_json
FROM a JOIN m USING (pair_id) LEFT JOIN c ON c.pair_id = a.pair_id AND c.sample_rank = dr""",
    "rule_flags": _c("max_shrink_pct", "total_area_ratio_exit_adjusted", "dp_cost")
    + """, f AS (SELECT *, coalesce(max_shrink_pct <= 10, FALSE) AS s, coalesce(total_area_ratio_exit_adjusted BETWEEN 0.9 AND 1.2, FALSE) AS r, coalesce(dp_cost <= 10, FALSE) AS k FROM c)
SELECT pair_id, sample_rank, s AS rule_plausible_shrink, r AS rule_plausible_area_ratio, k AS rule_plausible_cost, s OR r OR k AS rule_plausible_any, s AND r AND k AS rule_plausible_all,
  CAST(s AND r AND k AS DOUBLE) AS rule_based_probability FROM f""",
}
