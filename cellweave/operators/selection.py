"""Candidates of frame pairs: within-pair probabilities and ranks, selection, per-pair summaries, quality decisions.

A pair may hold any share of all rows. Summaries are aggregates that add up map-side, ranks are exact positions in a global sort
(`positions`), and pair values come back to rows by a join; there is no window over a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import ops
from cellweave.operators.positions import with_positions
from cellweave.schemas import FEATURES, finite, value
from cellweave.session import Stored, small_side


def candidates(scored: DataFrame, *columns: str) -> DataFrame:
    """(pair_id, sample_rank, *columns), each candidate once, NaN as NULL. Rows without pair_id are no candidates; sample_rank is the
    order in which candidates came, and settles ties."""
    doubles = {f.name for f in scored.schema.fields if f.dataType.typeName() in ("double", "float")}
    names = list(dict.fromkeys(["pair_id", "sample_rank", *columns]))
    return scored.where("pair_id IS NOT NULL").select(*[(value(c) if c in doubles else F.col(c)).alias(c) for c in names]).distinct()


def _pair_join(rows: DataFrame, per_pair: DataFrame) -> DataFrame:
    """Rows with their pair's values; a small table is sent along, a large one joins by shuffle, where Spark splits hot pairs."""
    return rows.join(small_side(Stored(per_pair).df), "pair_id", "left")


def pair_probabilities(c: DataFrame, temperature: float = 1.0) -> DataFrame:
    """c plus pair_probability, the softmax of the finite raw_score within the pair, and score_rank from 1, best first, ties by
    sample_rank. Both are NULL where raw_score isn't finite."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    s = finite("raw_score") / temperature
    top = c.groupBy("pair_id").agg(F.max(s).alias("_top"))
    rows = _pair_join(c.withColumn("_s", s), top).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    rows = Stored(rows).df
    rows = _pair_join(rows, rows.groupBy("pair_id").agg(F.sum("_e").alias("_sum")))
    ranked = with_positions(rows.withColumn("_none", F.col("_s").isNull()), ["pair_id"], [F.col("_none"), F.col("_s").desc(), F.col("sample_rank")], "_pos")
    rank = F.when(F.col("_s").isNotNull(), F.col("_pos") + 1).cast("double")
    return ranked.withColumn("pair_probability", F.col("_e") / F.col("_sum")).withColumn("score_rank", rank).drop("_s", "_top", "_e", "_sum", "_none", "_pos")


def uniform_prior(c: DataFrame) -> DataFrame:
    """c plus prior, one over the number of the pair's candidates."""
    return _pair_join(c, c.groupBy("pair_id").agg((1.0 / F.count("*")).alias("prior")))


def _chosen(score: Column) -> Column:
    return F.struct("sample_rank", "t", "ops_json", score.alias("score"))


SELECTED = ["pair_id", "t", "chosen_idx", "chosen_score", "chosen_ops_json"]


def _selection(picked: DataFrame) -> DataFrame:
    p = F.col("p")
    return picked.where("p IS NOT NULL").select("pair_id", p["t"].alias("t"), p["sample_rank"].alias("chosen_idx"), p["score"].alias("chosen_score"), p["ops_json"].alias("chosen_ops_json"))


def select_dp(c: DataFrame) -> DataFrame:
    """The candidate of least dp_cost of each pair, the first of equals; pairs without any cost have no row."""
    key = F.when(F.col("dp_cost").isNotNull(), F.struct("dp_cost", "sample_rank"))
    return _selection(c.groupBy("pair_id").agg(F.min_by(_chosen(F.col("dp_cost")), key).alias("p")))


def select_classifier(c: DataFrame) -> DataFrame:
    """The candidate of greatest raw_score of each pair, the first of equals; pairs without any score have no row."""
    key = F.when(F.col("raw_score").isNotNull(), F.struct("raw_score", -F.col("sample_rank")))
    return _selection(c.groupBy("pair_id").agg(F.max_by(_chosen(F.col("raw_score")), key).alias("p")))


def _alpha(alpha: float) -> float:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    return float(alpha)


def select_by_rank(c: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha times the rank by dp_cost plus the rest times the rank by raw_score, least first; ties by cost rank. Candidates without
    a cost or a finite score take no part."""
    a = _alpha(alpha)
    rows = c.where(F.col("dp_cost").isNotNull() & finite("raw_score").isNotNull())
    ranked = with_positions(rows, ["pair_id"], [F.col("dp_cost"), F.col("sample_rank")], "_dp")
    ranked = with_positions(ranked, ["pair_id"], [F.col("raw_score").desc(), F.col("sample_rank")], "_cls")
    mixed = a * (F.col("_dp") + 1) + (1 - a) * (F.col("_cls") + 1)
    return _selection(ranked.groupBy("pair_id").agg(F.min_by(_chosen(mixed), F.struct(mixed, "_dp")).alias("p")))


def select_by_zscore(c: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha times the z-score of -dp_cost plus the rest times that of raw_score, greatest first; a pair with one candidate or no spread
    has z-scores of 0. Candidates without a cost or a finite score take no part."""
    a = _alpha(alpha)
    rows = c.where(F.col("dp_cost").isNotNull() & finite("raw_score").isNotNull())
    moments = rows.groupBy("pair_id").agg(F.avg("dp_cost").alias("_md"), F.stddev_pop("dp_cost").alias("_sd"), F.avg("raw_score").alias("_mc"), F.stddev_pop("raw_score").alias("_sc"))
    r = _pair_join(rows, moments)
    z_dp = F.when(F.col("_sd") > 0, (F.col("_md") - F.col("dp_cost")) / F.col("_sd")).otherwise(0.0)
    z_cls = F.when(F.col("_sc") > 0, (F.col("raw_score") - F.col("_mc")) / F.col("_sc")).otherwise(0.0)
    mixed = F.round(a * z_dp + (1 - a) * z_cls, 9)
    return _selection(r.groupBy("pair_id").agg(F.max_by(_chosen(mixed), F.struct(mixed, -F.col("sample_rank"))).alias("p")))


SELECTORS: dict[str, Callable[..., DataFrame]] = {"dp_cost_min": select_dp, "classifier": select_classifier, "ensemble_rank": select_by_rank, "ensemble_zscore": select_by_zscore}


def select(c: DataFrame, scorer: str, **options: float) -> DataFrame:
    if scorer not in SELECTORS:
        raise ValueError(f"unknown scorer {scorer!r}; there are {', '.join(SELECTORS)}")
    return SELECTORS[scorer](c, **options)


def per_pair_features(c: DataFrame) -> DataFrame:
    """One row of 86 columns per pair: max, min, mean, std and the best candidate's value of each feature, and summaries of scores,
    costs and their disagreement. Infinite and missing values are left out; the best candidate has the greatest raw_score, else the least
    dp_cost, else it is the first."""
    best = F.struct(F.col("raw_score").isNotNull(), F.coalesce("raw_score", -F.col("dp_cost")), -F.col("sample_rank"))
    aggs: list[Column] = []
    for f in FEATURES:
        v = finite(f)
        aggs += [F.max(v).alias(f"{f}_max"), F.min(v).alias(f"{f}_min"), F.avg(v).alias(f"{f}_mean"), F.stddev_pop(v).alias(f"{f}_std")]
    best_of = F.max_by(F.struct(*[F.col(f) for f in FEATURES]), best).alias("_best")
    s, d, p = finite("raw_score"), finite("dp_cost"), finite("pair_probability")
    aggs += [
        F.max(s).alias("score_max"), F.min(s).alias("score_min"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"),
        F.min(F.struct(s.isNull().alias("n"), (-s).alias("v"), F.col("sample_rank").alias("r"))).alias("_first"),
        F.sum(p).alias("_p"), F.sum(F.when(p > 0, p * F.log(p))).alias("_plogp"), F.max("pair_probability").alias("score_max_pair_probability"),
        F.min(d).alias("dp_cost_min"), F.max(d).alias("dp_cost_max"), F.avg(d).alias("dp_cost_mean"),
        F.min_by(F.struct("dp_cost", "raw_score"), F.when(F.col("dp_cost").isNotNull(), F.struct("dp_cost", "sample_rank"))).alias("_dp"),
        F.max_by(F.struct("dp_cost", "raw_score"), F.when(F.col("raw_score").isNotNull(), F.struct("raw_score", -F.col("sample_rank")))).alias("_cls"),
        F.min("dataset_id").alias("dataset_id"), F.min("t").alias("t"), F.count("*").alias("n_candidates"),
    ]
    g = Stored(c.groupBy("pair_id").agg(*aggs, best_of)).df
    # the second best score: the best one without the row that holds it
    rest = _pair_join(c.select("pair_id", "sample_rank", "raw_score"), g.select("pair_id", F.col("_first.r").alias("_r")))
    second = rest.where(F.col("sample_rank") != F.col("_r")).groupBy("pair_id").agg(F.max(finite("raw_score")).alias("_second"))
    g = g.join(second, "pair_id", "left")
    dp_gap = F.greatest(F.col("_cls.dp_cost") - F.col("_dp.dp_cost"), F.lit(0.0)) / F.greatest(F.abs("_dp.dp_cost"), F.lit(1e-9))
    cls_gap = F.greatest(F.col("_cls.raw_score") - F.col("_dp.raw_score"), F.lit(0.0))
    known = F.col("_cls.dp_cost").isNotNull() & F.col("_dp.raw_score").isNotNull() & F.col("_dp.dp_cost").isNotNull() & F.col("_cls.raw_score").isNotNull()
    entropy = F.when(F.col("_p") > 0, F.log("_p") - F.col("_plogp") / F.col("_p"))
    out = [c_ for f in FEATURES for c_ in (*[F.col(f"{f}_{k}") for k in ("max", "min", "mean", "std")], F.col("_best")[f].alias(f"{f}_best"))]
    return g.select(
        "dataset_id", "pair_id", "t", F.col("n_candidates").cast("int").alias("n_candidates"), *out, "score_max", "score_min", "score_mean", "score_std", entropy.alias("score_entropy"),
        (F.col("score_max") - F.col("_second")).alias("score_margin_top1_top2"), "score_max_pair_probability", "dp_cost_min", "dp_cost_max", "dp_cost_mean",
        (F.col("dp_cost_max") - F.col("dp_cost_min")).alias("dp_cost_range"), F.when(known, F.sqrt(dp_gap * cls_gap)).alias("disagreement_score"),
    )


def pair_diagnostics(c: DataFrame) -> DataFrame:
    """Per pair: the first choices by cost and by score, the gaps between them, disagreement, margin, entropy of pair_probability as
    it is stored, and what is known of correctness."""
    s = finite("raw_score")
    p = finite("pair_probability")
    pick = F.struct("sample_rank", "dp_cost", "raw_score", "is_correct")
    g = c.groupBy("pair_id").agg(
        F.min("dataset_id").alias("dataset_id"), F.min("t").alias("t"), F.count("*").cast("int").alias("n_candidates"),
        F.min_by(pick, F.when(F.col("dp_cost").isNotNull(), F.struct("dp_cost", "sample_rank"))).alias("dp"),
        F.max_by(pick, F.when(F.col("raw_score").isNotNull(), F.struct("raw_score", -F.col("sample_rank")))).alias("cls"),
        F.max(s).alias("within_pair_max_score"), (-F.sum(F.when(p > 0, p * F.log(p)))).alias("within_pair_entropy"), F.bool_or("is_correct").alias("has_correct_candidate"),
    )
    gap = F.greatest(F.col("cls.dp_cost") - F.col("dp.dp_cost"), F.lit(0.0))
    norm = gap / F.greatest(F.abs("dp.dp_cost"), F.lit(1e-9))
    score_gap = F.greatest(F.col("cls.raw_score") - F.col("dp.raw_score"), F.lit(0.0))
    complete = F.col("dp.dp_cost").isNotNull() & F.col("cls.dp_cost").isNotNull() & F.col("dp.raw_score").isNotNull() & F.col("cls.raw_score").isNotNull()
    return g.select(
        "dataset_id", "pair_id", "t", "n_candidates", F.col("dp.sample_rank").alias("dp_top1_idx"), F.col("cls.sample_rank").alias("classifier_top1_idx"),
        F.coalesce(F.col("dp.sample_rank") != F.col("cls.sample_rank"), F.lit(False)).alias("classifier_disagrees_with_dp"),
        F.when(complete, gap).alias("dp_cost_gap"), F.when(complete, norm).alias("dp_cost_gap_normalised"), F.when(complete, score_gap).alias("classifier_score_gap"),
        F.when(complete, F.sqrt(norm * score_gap)).alias("disagreement_score"), "within_pair_max_score", "within_pair_entropy", "has_correct_candidate",
    )


def decide(diagnostics: DataFrame, selections: DataFrame, anomalies: DataFrame | None = None, disagreement: str = "never", soft_threshold: float = 0.5) -> DataFrame:
    """Diagnostics plus action KEEP or DROP, drop_reason and, of kept pairs, what was chosen. An anomaly comes before a hard
    disagreement (any), that before a soft one (finite and above the threshold). anomalies: (pair_id, anomaly_score, anomaly_flag)."""
    if disagreement not in ("never", "hard", "soft"):
        raise ValueError("disagreement is never, hard or soft")
    d = diagnostics.join(selections.select("pair_id", "chosen_idx", "chosen_ops_json"), "pair_id", "left")
    if anomalies is None:
        d = d.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("anomaly_flag", F.lit(False))
    else:
        d = d.join(anomalies.select("pair_id", "anomaly_score", "anomaly_flag"), "pair_id", "left").withColumn("anomaly_flag", F.coalesce("anomaly_flag", F.lit(False)))
    differs = F.col("classifier_disagrees_with_dp") if disagreement == "hard" else F.coalesce(finite("disagreement_score") > soft_threshold, F.lit(False)) if disagreement == "soft" else F.lit(False)
    d = d.withColumn("drop_reason", F.when(F.col("anomaly_flag"), "ANOMALY").when(differs, "DISAGREEMENT"))
    kept = F.col("drop_reason").isNull()
    d = d.withColumn("action", F.when(kept, "KEEP").otherwise("DROP"))
    return d.withColumn("chosen_idx", F.when(kept, F.col("chosen_idx"))).withColumn("chosen_ops_json", F.when(kept, F.col("chosen_ops_json")))


def decision_errors(decisions: DataFrame) -> DataFrame:
    """Decisions that contradict themselves, with what is wrong."""
    kept, dropped = F.col("action") == "KEEP", F.col("action") == "DROP"
    of = lambda c: F.col(c) if c in decisions.columns else F.lit(None)
    primary, start, end = F.coalesce(of("bridge_is_primary").cast("boolean"), F.lit(False)), of("bridge_t_a").cast("int"), of("bridge_t_b").cast("int")
    bridge, ops_, score = F.col("action") == "BRIDGE", of("bridge_ops_json").cast("string"), of("bridge_score").cast("double")
    wrong = (
        F.when(~F.coalesce(F.col("action").isin("KEEP", "DROP", "BRIDGE"), F.lit(False)), "unknown action")
        .when(kept & F.col("chosen_idx").isNull(), "kept without a candidate")
        .when(kept & F.col("drop_reason").isNotNull(), "kept with a reason to drop")
        .when(kept & (ops_.isNotNull() | primary), "kept with a bridge")
        .when(dropped & primary, "dropped as the start of a bridge")
        .when(bridge & (start.isNull() | end.isNull()), "bridge without a span")
        .when(bridge & (end <= start), "bridge that ends before it begins")
        .when(bridge & primary & (ops_.isNull() | finite(score).isNull()), "start of a bridge without operations or score")
        .when(bridge & ~primary & ops_.isNotNull(), "operations inside of a bridge")
        .when(dropped & F.col("drop_reason").isNull(), "dropped without a reason")
        .when(dropped & F.col("chosen_ops_json").isNotNull(), "dropped with operations")
    )
    return decisions.withColumn("error", wrong).where("error IS NOT NULL")


def rule_flags(c: DataFrame, ratio_column: str = "total_area_ratio_exit_adjusted", cost_column: str = "dp_cost") -> DataFrame:
    """c plus the rules' verdicts; a rule on a missing value says no. The area ratio may be named mass_ratio, the cost norm_cost."""
    shrink = F.coalesce(F.col("max_shrink_pct") <= 10, F.lit(False))
    ratio = F.coalesce(F.col(ratio_column).between(0.9, 1.2), F.lit(False))
    cost = F.coalesce(F.col(cost_column) <= 10, F.lit(False))
    out = c.withColumn("rule_plausible_shrink", shrink).withColumn("rule_plausible_area_ratio", ratio).withColumn("rule_plausible_cost", cost)
    every = shrink & ratio & cost
    return out.withColumn("rule_plausible_any", shrink | ratio | cost).withColumn("rule_plausible_all", every).withColumn("rule_based_probability", every.cast("double"))


def parsed(c: DataFrame) -> DataFrame:
    """c with its operations counted, checked and in canonical and compact form."""
    o = ops.parse("ops_json")
    return c.select("pair_id", "sample_rank", *[ops.count(o, k).alias(f"{k}s") for k in ops.ARITY], ops.canonical(o).alias("canonical_key"), ops.compact(o).alias("compact"), ops.error(o).alias("error"))


def first_of_equals(c: DataFrame) -> DataFrame:
    """The first candidate of each canonical form within its pair."""
    return parsed(c).groupBy("pair_id", "canonical_key").agg(F.min("sample_rank").alias("sample_rank"))
