"""Scorers of candidates: naive Bayes with closed-form families, logistic regression, trees; folds by dataset; calibration.

Training and scoring are Spark jobs: sufficient statistics are one aggregate, log densities are columns, the rest is Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.schemas import FEATURES, finite, require

#: Families of the naive Bayes model; a feature not named is normal on its logarithm if its values are above 0, else normal.
FLOOR, LEAST_PROBABILITY, LEAST_DENSITY = 1e-6, 0.01, -30.0


def sufficient_statistics(rows: DataFrame, features: Sequence[str] = FEATURES, target: str = "is_correct") -> DataFrame:
    """(is_correct, feature, n, n_seen, mean, std, mean_log, std_log, n_log): what the normal families are fitted from; NULL targets are left out."""
    require(rows, [target, *features])
    labelled = rows.where(F.col(target).isNotNull())
    flat = labelled.select(F.col(target).alias("is_correct"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("v")) for f in features])).alias("x")).select("is_correct", "x.*")
    log = F.when(F.col("v") > FLOOR, F.log("v"))
    return flat.groupBy("is_correct", "feature").agg(
        F.count("*").alias("n"), F.count("v").alias("n_seen"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(log).alias("mean_log"), F.stddev_pop(log).alias("std_log"), F.count(log).alias("n_log")
    )


#: Family of each feature: gamma and beta values are shifted off their borders by EPS.
FAMILIES = {f: "beta" if "iou" in f else "gamma" if f == "max_shrink_pct" or "_dy_" in f or "dist" in f else "lognormal" for f in FEATURES}
EPS = 1e-9


def _within(family: str, v: Column) -> Column:
    """A value as its family may have it."""
    return F.least(F.greatest(v, F.lit(EPS)), F.lit(1 - EPS)) if family == "beta" else F.greatest(v, F.lit(EPS))


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift, x = shift - 1 / x, x + 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _trigamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift, x = shift + 1 / (x * x), x + 1
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def fit_gamma(mean: float, mean_log: float) -> tuple[float, float] | None:
    """(shape, scale) of greatest likelihood, by Newton's method on log(shape) - digamma(shape) = log(mean) - mean of logs."""
    s = math.log(mean) - mean_log
    if not s > 1e-12:
        return None
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(60):
        step = (math.log(a) - _digamma(a) - s) / (1 / a - _trigamma(a))
        a = a / 2 if step >= a else a - step
        if abs(step) < 1e-12 * a:
            break
    return a, mean / a


def fit_beta(mean: float, var: float, mean_log: float, mean_log_rest: float) -> tuple[float, float] | None:
    """(a, b) of greatest likelihood from the means of log x and log(1 - x), by Newton's method from the moments' estimate."""
    if not 0 < var < mean * (1 - mean):
        return None
    whole = mean * (1 - mean) / var - 1
    a, b = mean * whole, (1 - mean) * whole
    for _ in range(100):
        both, t = _digamma(a + b), _trigamma(a + b)
        ga, gb = both - _digamma(a) + mean_log, both - _digamma(b) + mean_log_rest
        haa, hbb = t - _trigamma(a), t - _trigamma(b)
        det = haa * hbb - t * t
        da, db = (hbb * ga - t * gb) / det, (haa * gb - t * ga) / det
        a, b = a / 2 if da >= a else a - da, b / 2 if db >= b else b - db
        if abs(da) < 1e-10 * a and abs(db) < 1e-10 * b:
            break
    return a, b


def family_statistics(rows: DataFrame, features: Sequence[str] = FEATURES, target: str = "is_correct", families: dict[str, str] | None = None) -> DataFrame:
    """(is_correct, feature, n, n_seen, mean, var, mean_log, var_log, mean_log_rest): sums that determine every family's fit."""
    require(rows, [target, *features])
    families = FAMILIES if families is None else families
    items = [F.struct(F.lit(f).alias("feature"), _within(families.get(f, "lognormal"), finite(f)).alias("v"), finite(f).isNotNull().alias("seen")) for f in features]
    flat = rows.where(F.col(target).isNotNull()).select(F.col(target).alias("is_correct"), F.explode(F.array(*items)).alias("x")).select("is_correct", "x.feature", F.when(F.col("x.seen"), F.col("x.v")).alias("v"))
    log, rest = F.log("v"), F.when(F.col("v") < 1, F.log1p(-F.col("v")))
    return flat.groupBy("is_correct", "feature").agg(
        F.count("*").alias("n"), F.count("v").alias("n_seen"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.avg(log).alias("mean_log"), F.var_pop(log).alias("var_log"), F.avg(rest).alias("mean_log_rest")
    )


@dataclass
class NaiveBayes:
    """Per feature and class: probability of being there, family, and the family's two parameters; family "none" says nothing of a value."""

    parameters: dict[tuple[str, bool], tuple[float, str, float, float]]
    prior: float | str

    def density(self, f: str, correct: bool) -> Column:
        seen, family, a, b = self.parameters[f, correct]
        v = finite(f)
        x = _within(family, v)
        if family == "lognormal":
            d = -0.5 * ((F.log(x) - a) / b) ** 2 - math.log(b * math.sqrt(2 * math.pi)) - F.log(x)
        elif family == "gamma":
            d = (a - 1) * F.log(x) - x / b - (math.lgamma(a) + a * math.log(b))
        elif family == "beta":
            d = (a - 1) * F.log(x) + (b - 1) * F.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        elif family == "normal":
            d = -0.5 * ((v - a) / b) ** 2 - math.log(b * math.sqrt(2 * math.pi))
        else:
            d = F.lit(0.0)
        present = F.greatest(d, F.lit(LEAST_DENSITY)) + math.log(max(seen, LEAST_PROBABILITY))
        return F.when(v.isNotNull(), present).otherwise(math.log(max(1 - seen, LEAST_PROBABILITY)))

    def contributions(self) -> dict[str, Column]:
        """Each feature's part of the log likelihood ratio."""
        return {f: self.density(f, True) - self.density(f, False) for f in sorted({k[0] for k in self.parameters})}

    def fitted_params(self, spark: SparkSession) -> DataFrame:
        """(feature, is_correct, p_seen, family, a, b), a row per feature and class."""
        return spark.createDataFrame([(f, c, *p) for (f, c), p in sorted(self.parameters.items())], "feature STRING, is_correct BOOLEAN, p_seen DOUBLE, family STRING, a DOUBLE, b DOUBLE")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows plus raw_score, the log likelihood ratio, and candidate_correctness_probability under the prior: a number, or "uniform_within_pair",
        one over the number of the pair's rows."""
        parts = list(self.contributions().values())
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out = rows.withColumn("raw_score", total)
        if self.prior == "uniform_within_pair":
            sizes = rows.groupBy(F.col("pair_id").alias("_pair")).agg(F.count("*").alias("_n"))
            out = out.join(sizes, F.col("pair_id").eqNullSafe(F.col("_pair"))).withColumn("_odds", F.when(F.col("_n") > 1, -F.log(F.col("_n") - 1)).otherwise(700.0)).drop("_pair", "_n")
        else:
            out = out.withColumn("_odds", F.lit(math.log(self.prior / (1 - self.prior))))
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("raw_score") + F.col("_odds"), F.lit(700.0)), F.lit(-700.0))))
        return out.withColumn("candidate_correctness_probability", p).drop("_odds")

    def save(self, spark: SparkSession, path: str) -> None:
        """As a JSON table in the shared file system; refuses to overwrite."""
        self.fitted_params(spark).withColumn("prior", F.lit(str(self.prior))).coalesce(1).write.mode("errorifexists").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayes:
        rows = spark.read.schema("feature STRING, is_correct BOOLEAN, p_seen DOUBLE, family STRING, a DOUBLE, b DOUBLE, prior STRING").json(path).collect()
        prior = rows[0]["prior"]
        return NaiveBayes({(r["feature"], r["is_correct"]): (r["p_seen"], r["family"], r["a"], r["b"]) for r in rows}, prior if prior == "uniform_within_pair" else float(prior))


def fit_naive_bayes(rows: DataFrame, features: Sequence[str] = FEATURES, target: str = "is_correct", families: dict[str, str] | None = None, prior: float | str = "empirical") -> NaiveBayes:
    """Both classes must occur. The sums are one row per class and feature. Fewer than 3 values, or values without spread, give family "none"; a beta or
    gamma fit that fails gives a normal one. prior: "empirical", "uniform_within_pair" or a number between 0 and 1."""
    families = FAMILIES if families is None else families
    stats = family_statistics(rows, features, target, families).collect()
    by = {(r["feature"], r["is_correct"]): r for r in stats}
    if {k[1] for k in by} != {True, False}:
        raise ValueError("training needs candidates of both classes")
    out = {}
    for (f, c), r in by.items():
        seen, family, fit = r["n_seen"] / r["n"], families.get(f, "lognormal"), None
        if r["n_seen"] >= 3:
            if family == "gamma":
                fit = fit_gamma(r["mean"], r["mean_log"])
            elif family == "beta":
                fit = fit_beta(r["mean"], r["var"], r["mean_log"], r["mean_log_rest"])
            elif family == "lognormal" and r["var_log"] > 0:
                fit = (r["mean_log"], math.sqrt(r["var_log"]))
            if fit is None and r["var"] > 0:
                family, fit = "normal", (r["mean"], math.sqrt(r["var"]))
        out[f, c] = (seen, family, *fit) if fit else (seen, "none", 0.0, 1.0)
    if prior == "empirical":
        n = {c: next(r["n"] for r in stats if r["is_correct"] == c) for c in (True, False)}
        prior = n[True] / (n[True] + n[False])
    elif prior != "uniform_within_pair" and not (isinstance(prior, float) and 0 < prior < 1):
        raise ValueError("prior is empirical, uniform_within_pair or a number between 0 and 1")
    return NaiveBayes(out, prior)


def _estimator(name: str, n: int):
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "logreg_l2_balanced":
        return LogisticRegression(**common, weightCol="weight", regParam=1 / max(n, 1), elasticNetParam=0.0, standardization=False)
    if name == "logreg_l1_balanced":
        return LogisticRegression(**common, weightCol="weight", regParam=1 / max(n, 1), elasticNetParam=1.0, standardization=False)
    if name == "linear_svm_balanced":
        return LinearSVC(**common, weightCol="weight", regParam=1 / max(n, 1))
    if name == "random_forest_balanced":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=400, maxDepth=30, minInstancesPerNode=2, seed=42)
    if name == "hist_gbm":
        return GBTClassifier(**common, maxIter=300, stepSize=0.05, maxDepth=5, minInstancesPerNode=20, seed=42)
    raise ValueError(f"unknown model {name!r}")


_PREPARATION = "name STRING, feature STRING, median DOUBLE, gap BOOLEAN, place INT"


@dataclass
class Scorer:
    """A fitted model: medians for missing values, which features may be missing, and the ML pipeline."""

    name: str
    features: list[str]
    medians: dict[str, float]
    gaps: list[str]
    model: PipelineModel

    def prepared(self, rows: DataFrame) -> DataFrame:
        out = rows
        for f in self.features:
            out = out.withColumn(f"_{f}", F.coalesce(finite(f), F.lit(self.medians[f])))
        for f in self.gaps:
            out = out.withColumn(f"_{f}_missing", finite(f).isNull().cast("double"))
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """rows plus raw_score (logit or margin), candidate_correctness_probability (NULL for a margin) and score_model."""
        scored = self.model.transform(self.prepared(rows))
        raw = vector_to_array("rawPrediction")[1]
        if "probability" in scored.columns:
            p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-9)), F.lit(1e-9))
            raw = F.log(p / (1 - p))
        else:
            p = F.lit(None).cast("double")
        kept = [F.col(c) for c in rows.columns if c not in ("raw_score", "candidate_correctness_probability", "score_model")]
        return scored.select(*kept, raw.alias("raw_score"), p.alias("candidate_correctness_probability"), F.lit(self.name).alias("score_model"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Model and preparation, in the shared file system; refuses to overwrite."""
        rows = [(self.name, f, self.medians[f], f in self.gaps, i) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, _PREPARATION).coalesce(1).write.mode("errorifexists").json(f"{path}/preparation")
        self.model.save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        rows = spark.read.schema(_PREPARATION).json(f"{path}/preparation").orderBy("place").collect()
        return Scorer(rows[0]["name"], [r["feature"] for r in rows], {r["feature"]: r["median"] for r in rows}, [r["feature"] for r in rows if r["gap"]], PipelineModel.load(f"{path}/model"))


def fit_scorer(rows: DataFrame, name: str = "logreg_l2_balanced", features: Sequence[str] = FEATURES, target: str = "is_correct") -> Scorer:
    """Labelled rows to a scorer; classes weigh the same in sum. Missing values become medians, with an indicator per feature that
    misses some."""
    require(rows, [target, *features])
    labelled = rows.where(F.col(target).isNotNull())
    facts = labelled.agg(
        F.count("*").alias("n"), F.sum(F.col(target).cast("int")).alias("n1"), *[F.percentile_approx(finite(f), 0.5, 10_000).alias(f"m_{f}") for f in features], *[F.count(finite(f)).alias(f"c_{f}") for f in features]
    ).first()
    if not facts["n1"] or facts["n1"] == facts["n"]:
        raise ValueError("training needs candidates of both classes")
    names = list(features)
    s = Scorer(name, names, {f: facts[f"m_{f}"] or 0.0 for f in names}, [f for f in names if facts[f"c_{f}"] < facts["n"]], PipelineModel([]))
    weight = F.when(F.col(target), facts["n"] / (2 * facts["n1"])).otherwise(facts["n"] / (2 * (facts["n"] - facts["n1"])))
    train = s.prepared(labelled).withColumn("label", F.col(target).cast("double")).withColumn("weight", weight)
    inputs = [f"_{f}" for f in names] + [f"_{f}_missing" for f in s.gaps]
    stages = [VectorAssembler(inputCols=inputs, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), _estimator(name, facts["n"])]
    s.model = Pipeline(stages=stages).fit(train)
    return s


def fold_of(group: Column, folds: int) -> Column:
    """The fold of a group, such as a dataset, by its hash; NULL is a group of its own."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def score_left_out(rows: DataFrame, name: str = "logreg_l2_balanced", features: Sequence[str] = FEATURES, folds: int = 5, group: str = "dataset_id") -> DataFrame:
    """rows plus the columns of `Scorer.score`, each dataset scored by a scorer fitted on the other folds of datasets; as many fits as folds, whatever the
    number of datasets. A fold without rows is passed over; `folds` of the number of datasets and more leaves out about one at a time."""
    rows = rows.withColumn("_fold", fold_of(F.col(group), folds))
    out = None
    for k in [r[0] for r in rows.select("_fold").distinct().orderBy("_fold").collect()]:
        part = fit_scorer(rows.where(F.col("_fold") != k), name, features).score(rows.where(F.col("_fold") == k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rows to score")
    return out.drop("_fold")


def _calibrator(train: DataFrame, method: str) -> Callable[[DataFrame], DataFrame]:
    """A function from rows with a finite raw_score to the same with _p."""
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="raw_score", labelCol="label").fit(train)
        return lambda rows: model.transform(rows).withColumnRenamed("prediction", "_p")
    if method != "sigmoid":
        raise ValueError("method is isotonic or sigmoid")
    assemble = VectorAssembler(inputCols=["raw_score"], outputCol="_one")
    model = LogisticRegression(featuresCol="_one", labelCol="label").fit(assemble.transform(train))
    return lambda rows: model.transform(assemble.transform(rows)).select(*rows.columns, vector_to_array("probability")[1].alias("_p"))


def calibrate(rows: DataFrame, name: str = "logreg_l2_balanced", features: Sequence[str] = FEATURES, method: str = "isotonic", folds: int = 5, target: str = "is_correct", group: str = "pair_id") -> Callable[[DataFrame], DataFrame]:
    """A function from rows to rows with raw_score and calibrated candidate_correctness_probability: for each fold of pairs a scorer is fitted on the others
    and calibrated on the fold, which it hasn't seen; the probability is the mean over folds."""
    labelled = rows.where(F.col(target).isNotNull()).withColumn("_fold", fold_of(F.col(group), folds))
    pairs = []
    for k in range(folds):
        held = labelled.where(F.col("_fold") == k)
        if held.select(target).distinct().count() < 2:
            continue
        scorer = fit_scorer(labelled.where(F.col("_fold") != k), name, features, target)
        train = scorer.score(held).where(finite("raw_score").isNotNull()).withColumn("label", F.col(target).cast("double"))
        pairs.append((scorer, _calibrator(train, method)))
    if not pairs:
        raise ValueError("no fold has rows of both classes")

    def apply(new: DataFrame) -> DataFrame:
        out = new.drop("raw_score", "candidate_correctness_probability", "score_model")
        kept = out.columns
        for i, (scorer, curve) in enumerate(pairs):
            scored = curve(scorer.score(out)).withColumnRenamed("_p", f"_p{i}").withColumnRenamed("raw_score", f"_r{i}")
            out = scored.drop("candidate_correctness_probability", "score_model")
        mean = lambda k: sum((F.col(f"_{k}{i}") for i in range(len(pairs))), F.lit(0.0)) / len(pairs)
        return out.select(*kept, mean("r").alias("raw_score"), mean("p").alias("candidate_correctness_probability"), F.lit(f"{name}_calibrated").alias("score_model"))

    return apply


@dataclass
class Detector:
    """Flags pairs whose model score reaches a threshold as anomalies."""

    scorer: Scorer
    threshold: float

    def detect(self, per_pair: DataFrame) -> DataFrame:
        """(pair_id, anomaly_score, anomaly_flag) of the rows of `selection.per_pair_features`."""
        s = self.scorer.score(per_pair)
        score = F.coalesce("candidate_correctness_probability", "raw_score")
        return s.select("pair_id", score.alias("anomaly_score"), (score >= self.threshold).alias("anomaly_flag"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.scorer.save(spark, f"{path}/scorer")
        spark.createDataFrame([(self.threshold,)], "threshold DOUBLE").coalesce(1).write.mode("errorifexists").json(f"{path}/threshold")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        return Detector(Scorer.load(spark, f"{path}/scorer"), spark.read.schema("threshold DOUBLE").json(f"{path}/threshold").first()[0])


def train_detector(per_pair: DataFrame, features: Sequence[str], recall: float = 0.95, target: str = "has_error", folds: int = 0, group: str = "dataset_id", name: str = "hist_gbm") -> Detector:
    """A detector of the pairs whose target is true; its threshold is the greatest at which `recall` of them are found, on the training rows, or, with
    folds of datasets, the median of the folds' thresholds on rows their model hasn't seen, 0.5 if no fold has both classes."""
    scorer = fit_scorer(per_pair, name, features, target)
    column = "candidate_correctness_probability"

    def threshold(model: Scorer, rows: DataFrame) -> float:
        scored = model.score(rows)
        return recall_threshold(scored.withColumn("raw_score", F.coalesce(column, "raw_score")), recall, target)

    if not folds:
        return Detector(scorer, threshold(scorer, per_pair))
    rows = per_pair.withColumn("_fold", fold_of(F.col(group), folds))
    found = []
    for k in range(folds):
        train, held = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
        if min(x.where(F.col(target).isNotNull()).select(target).distinct().count() for x in (train, held)) == 2:
            found.append(threshold(fit_scorer(train, name, features, target), held))
    found.sort()
    middle = (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2 if found else 0.5
    return Detector(scorer, middle)


def recall_threshold(scored: DataFrame, recall: float, target: str = "is_correct") -> float:
    """The greatest score at which at least `recall` of the positives are kept; 0 without positives."""
    positives = scored.where(F.col(target) & finite("raw_score").isNotNull())
    n = positives.count()
    if not n:
        return 0.0
    counts = positives.groupBy("raw_score").count()
    need = math.ceil(recall * n)
    # positives at or above a score, by a global sort of the distinct scores
    from cellweave.operators.positions import with_running_sums

    ordered = with_running_sums(counts.withColumn("g", F.lit("all")), "g", [F.col("raw_score").desc()], "count")
    return ordered.where(F.col("before") + F.col("count") >= need).agg(F.max("raw_score")).first()[0]
