"""Queries over scored as training data: naive Bayes statistics and scores, logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.operators import scoring
from cellweave.operators import selection as sel
from cellweave.plans.candidates import _rounded
from cellweave.schemas import FEATURES
from cellweave.session import Stored, table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.candidates(table(spark, sf_dir, "scored"), "dataset_id", "is_correct", *FEATURES)


def nb_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.sufficient_statistics(_rows(spark, sf_dir)))


def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Stored(_rows(spark, sf_dir)).df
    return scoring.fit_naive_bayes(rows).score(rows).select("pair_id", "sample_rank", "raw_score", "candidate_correctness_probability")


def nb_lognormal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes with the family that closed forms fit."""
    rows = Stored(_rows(spark, sf_dir)).df
    model = scoring.fit_naive_bayes(rows, families={f: "lognormal" for f in FEATURES})
    return _rounded(model.score(rows).select("pair_id", "sample_rank", "raw_score", "candidate_correctness_probability"))


def nb_family_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gamma, beta and lognormal fits come from."""
    return _rounded(scoring.family_statistics(_rows(spark, sf_dir)))


def left_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate scored by a model that hasn't seen its dataset's fold."""
    rows = Stored(_rows(spark, sf_dir)).df
    return scoring.score_left_out(rows, folds=3).select("pair_id", "sample_rank", "raw_score", "candidate_correctness_probability")


def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Stored(_rows(spark, sf_dir)).df
    scored = scoring.fit_scorer(rows).score(rows)
    return sel.pair_probabilities(scored.select("pair_id", "sample_rank", "raw_score", "candidate_correctness_probability"))


QUERIES = {f.__name__: f for f in (nb_statistics, nb_family_statistics, nb_scores, nb_lognormal_scores, logreg_scores, left_out_scores)}


def _f(x: str) -> str:
    return f"CAST(CAST(round({x}, 12) AS FLOAT) AS DOUBLE)"


def _nb_sql() -> str:
    facts, parts = [], []
    for f in FEATURES:
        x = f"CASE WHEN isfinite({f}) THEN ln(greatest({f}, 1e-9)) END"
        for c, w in (("t", "is_correct"), ("f", "NOT is_correct")):
            facts += [f"count(CASE WHEN {w} THEN {x} END) / count(CASE WHEN {w} THEN 1 END) AS {f}_p{c}", f"avg(CASE WHEN {w} THEN {x} END) AS {f}_m{c}", f"stddev_pop(CASE WHEN {w} THEN {x} END) AS {f}_s{c}"]
        side = lambda c: f"CASE WHEN isfinite({f}) THEN greatest(-0.5 * ((ln(greatest({f}, 1e-9)) - {f}_m{c}) / {f}_s{c}) ** 2 - ln({f}_s{c} * sqrt(2 * pi())) - ln(greatest({f}, 1e-9)), -30) + ln(greatest({f}_p{c}, 0.01)) ELSE ln(greatest(1 - {f}_p{c}, 0.01)) END"  # noqa: B023, E731
        parts.append(f"({side('t')} - {side('f')})")
    return f"""WITH c AS (SELECT DISTINCT dataset_id, pair_id, sample_rank, is_correct, {", ".join(FEATURES)} FROM scored WHERE pair_id IS NOT NULL),
a AS (SELECT {", ".join(facts)}, count(CASE WHEN is_correct THEN 1 END) / count(is_correct) AS prior FROM c WHERE is_correct IS NOT NULL),
s AS (SELECT pair_id, sample_rank, prior, {" + ".join(parts)} AS raw FROM c, a)
SELECT pair_id, sample_rank, {_f("raw")} AS raw_score, {_f("1 / (1 + exp(-greatest(least(raw + ln(prior / (1 - prior)), 700), -700)))")} AS candidate_correctness_probability FROM s"""


def _family_sql() -> str:
    bounded = {f: f"least(greatest({f}, 1e-9), 1 - 1e-9)" if scoring.FAMILIES[f] == "beta" else f"greatest({f}, 1e-9)" for f in FEATURES}
    values = ", ".join(f"CASE WHEN isfinite({f}) THEN {bounded[f]} END" for f in FEATURES)
    return f"""WITH c AS (SELECT DISTINCT dataset_id, pair_id, sample_rank, is_correct, {", ".join(FEATURES)} FROM scored WHERE pair_id IS NOT NULL),
x AS (SELECT is_correct, unnest([{_NAMES}]) AS feature, unnest([{values}]) AS v FROM c WHERE is_correct IS NOT NULL)
SELECT is_correct, feature, count(*) AS n, count(v) AS n_seen, {_f("avg(v)")} AS mean, {_f("var_pop(v)")} AS var, {_f("avg(ln(v))")} AS mean_log, {_f("var_pop(ln(v))")} AS var_log, {_f("avg(CASE WHEN v < 1 THEN ln(1 - v) END)")} AS mean_log_rest FROM x GROUP BY ALL"""


_NAMES = ", ".join(f"'{f}'" for f in FEATURES)
SQL = {
    "nb_lognormal_scores": _nb_sql(),
    "nb_family_statistics": _family_sql(),
    "nb_statistics": f"""WITH c AS (SELECT DISTINCT dataset_id, pair_id, sample_rank, is_correct, {", ".join(FEATURES)} FROM scored WHERE pair_id IS NOT NULL),
x AS (SELECT is_correct, unnest([{_NAMES}]) AS feature, unnest([{", ".join(FEATURES)}]) AS v FROM c WHERE is_correct IS NOT NULL),
y AS (SELECT is_correct, feature, CASE WHEN isfinite(v) THEN v END AS v, CASE WHEN isfinite(v) AND v > 1e-6 THEN ln(v) END AS l FROM x)
SELECT is_correct, feature, count(*) AS n, count(v) AS n_seen, {_f("avg(v)")} AS mean, {_f("stddev_pop(v)")} AS std, {_f("avg(l)")} AS mean_log, {_f("stddev_pop(l)")} AS std_log, count(l) AS n_log FROM y GROUP BY ALL""",
}
