"""Delay regressors and severe-delay classifiers on ``pyspark.ml``."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.contract import SEVERE_THRESHOLDS, UNKNOWN, feature_projection
from priorline.functions.rows import (
    CALIBRATED_BANDS, PLAIN_BANDS, check_calibration_split, first_present, risk_band, sample_weight, with_residuals,
)
from priorline.operators import metrics
from priorline.operators.metrics import CALIBRATION_CUTOFFS
from priorline.operators.quantiles import exact_quantiles
from priorline.operators.reports import high_delay
from priorline.plans import boosting
from priorline.sources.durable import durable

METHODS = ["uncalibrated", "sigmoid", "isotonic"]
MODES = ["bus", "streetcar"]
MAX_DELAY = 240.0
PASS_THROUGH = {
    "mode": ["mode"], "route": ["route"], "incident": ["incident"], "location": ["location"],
    "timestamp": ["timestamp", "ts", "date"],
}


@dataclass(frozen=True)
class TreeConfig:
    """Boosting settings; the defaults are the fixed configuration of the regressor."""

    rounds: int = 400
    step: float = 0.05
    depth: int = 6
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    # Categories that the caller wants hashed; all others are one-hot encoded, whatever their size. The
    # index of a one-hot encoded category lives on the driver.
    hashed: tuple[str, ...] = ()
    hash_slots: int = 1_024

    def tree(self) -> dict:
        return {
            "maxIter": self.rounds, "stepSize": self.step, "maxDepth": self.depth,
            "subsamplingRate": self.row_share, "featureSubsetStrategy": str(self.column_share), "seed": self.seed,
        }


CLASSIFIER = TreeConfig(depth=5)


def training_rows(df: DataFrame, features: Sequence[str], target: str = "min_delay") -> DataFrame:
    """Rows with a target; a missing feature or target column is an error."""
    missing = [c for c in [*features, target] if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return df.where(F.col(target).isNotNull())


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each numeric column (the mean of the two middle values); None without values."""
    if not columns:
        return {}
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(values.alias("cell")).select("cell.name", "cell.value").where("value IS NOT NULL")
    found = exact_quantiles(long, ["name"], "value", {"median": 0.5})
    return dict.fromkeys(columns) | {row["name"]: row["median"] for row in found.collect()}


def preprocessing(df: DataFrame, categoricals: Sequence[str], numerics: Sequence[str], config: TreeConfig) -> list:
    """Stages: median for missing numbers, Unknown for missing categories, one-hot (unseen = zeros).

    Statistics come from ``df`` only, which must be the training rows. Numeric columns without
    any value carry nothing and are left out.
    """
    medians = exact_medians(df, numerics)
    numerics = [c for c in numerics if medians[c] is not None]
    small = [c for c in categoricals if c not in config.hashed]
    large = [c for c in categoricals if c in config.hashed]
    columns = [f"COALESCE(CAST(`{c}` AS DOUBLE), {medians[c]!r}D) AS `x_{c}`" for c in numerics]
    columns += [f"COALESCE(`{c}`, '{UNKNOWN}') AS `x_{c}`" for c in categoricals]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    inputs = [f"x_{c}" for c in numerics]
    if small:
        index, hot = [f"i_{c}" for c in small], [f"h_{c}" for c in small]
        stages.append(StringIndexer(inputCols=[f"x_{c}" for c in small], outputCols=index, handleInvalid="keep"))
        # The extra index of unseen values is the dropped last category: all zeros.
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot))
        inputs += hot
    if large:
        stages.append(
            FeatureHasher(inputCols=[f"x_{c}" for c in large], outputCol="h_large", numFeatures=config.hash_slots)
        )
        inputs.append("h_large")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def prepared_for(
    rows: DataFrame, categoricals: Sequence[str], numerics: Sequence[str], config: TreeConfig, shared: dict | None = None
) -> PipelineModel:
    """The fitted stages of ``preprocessing``; fits of the same rows hand over one ``shared`` dict and make them once."""
    made = {} if shared is None else shared
    key = (*categoricals, None, *numerics, None, *config.hashed, config.hash_slots)
    if key not in made:
        made[key] = Pipeline(stages=preprocessing(rows, categoricals, numerics, config)).fit(rows)
    return made[key]


def _trees(prepared: PipelineModel, rows: DataFrame, config: TreeConfig, classes: bool):
    """The boosted trees of rows (_label, _weight, inputs of the preprocessing stages).

    Hashed categories have few slots, so MLlib's learner can hold them; the others may have any number of values.
    """
    table = prepared.transform(rows)
    if config.hashed:
        kind = GBTClassifier if classes else GBTRegressor
        return kind(labelCol="_label", weightCol="_weight", predictionCol="_raw", **config.tree()).fit(table)
    index = [c for stage in prepared.stages if isinstance(stage, StringIndexerModel) for c in stage.getOutputCols()]
    sizes = [len(labels) for stage in prepared.stages if isinstance(stage, StringIndexerModel) for labels in stage.labelsArray]
    inputs = prepared.stages[-1].getInputCols()
    layout = boosting.Layout([c for c in inputs if c[:2] == "x_"], index, sizes)
    trees = boosting.boosted(
        table, layout, classes, config.rounds, config.step, config.depth, config.row_share, config.column_share, config.seed
    )
    return boosting.as_model(rows.sparkSession, trees, layout, classes).setPredictionCol("_raw")


def _helper_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:2] in ("x_", "f_", "i_", "h_") or c in ("features", "_raw", "rawPrediction")]


def predict(model, df: DataFrame) -> DataFrame:
    """Rows with a ``prediction`` column (works for every regressor of this module)."""
    out = model.transform(df)
    return out.drop(*_helper_columns(out))


def fit_regressor(
    train: DataFrame, config: TreeConfig = TreeConfig(), weighted: bool = False, log_target: bool = False,
    target: str = "min_delay", shared: dict | None = None,
) -> PipelineModel:
    """Boosted trees on the plain target, with bucket weights, or on log1p of the target.

    The log variant predicts expm1, limited to 0 … 240.
    """
    features, categoricals, numerics = feature_projection(train.columns)
    rows = training_rows(train, features, target)
    label = F.log1p(target) if log_target else F.col(target).cast("double")
    rows = rows.withColumn("_label", label)
    shown = f"LEAST(GREATEST(EXPM1(_raw), 0.0D), {MAX_DELAY}D)" if log_target else "_raw"
    last = SQLTransformer(statement=f"SELECT *, {shown} AS prediction FROM __THIS__")
    rows = rows.withColumn("_weight", sample_weight(F.col(target)) if weighted else F.lit(1.0))
    prepared = prepared_for(rows, categoricals, numerics, config, shared)
    return PipelineModel([*prepared.stages, _trees(prepared, rows, config, False), last])


@dataclass
class ModeModels:
    """One regressor per mode."""

    models: dict[str, PipelineModel]

    def transform(self, df: DataFrame) -> DataFrame:
        if "mode" not in df.columns:
            raise ValueError("Mode-specific prediction requires column 'mode'.")
        left_over = df.where(F.col("mode").isNotNull() & ~F.col("mode").isin(list(self.models)))
        unknown = left_over.agg(F.sort_array(F.collect_set("mode"))).first()[0]
        if unknown:
            raise ValueError(f"No mode-specific model is available for modes: {unknown}")
        # Rows without a mode stay, without a prediction.
        out = df.where(F.col("mode").isNull()).withColumn("prediction", F.lit(None).cast("double"))
        for mode, model in self.models.items():
            out = out.unionByName(predict(model, df.where(F.col("mode") == mode)))
        return out


def fit_mode_models(train: DataFrame, config: TreeConfig = TreeConfig(), modes: Sequence[str] = MODES) -> ModeModels:
    if "mode" not in train.columns:
        raise ValueError("Mode-specific experiment requires a 'mode' column.")
    counts = train.agg(*[F.count_if(F.col("mode") == m).alias(m) for m in modes]).first()
    missing = sorted(m for m in modes if not counts[m])
    if missing:
        raise ValueError(f"Cannot train mode-specific models; missing modes: {missing}")
    return ModeModels({m: fit_regressor(train.where(F.col("mode") == m), config) for m in modes})


EXPERIMENTS = {
    "combined_fixed": lambda train, config, shared: fit_regressor(train, config, shared=shared),
    "combined_weighted": lambda train, config, shared: fit_regressor(train, config, weighted=True, shared=shared),
    "combined_log_target": lambda train, config, shared: fit_regressor(train, config, log_target=True, shared=shared),
    "mode_specific": lambda train, config, _: fit_mode_models(train, config),
}


@dataclass
class ExperimentResult:
    metrics: DataFrame
    by_mode: DataFrame
    high_delay: DataFrame
    selected: DataFrame
    models: dict = field(default_factory=dict)


def run_experiments(
    df: DataFrame, config: TreeConfig = TreeConfig(), names: Sequence[str] = tuple(EXPERIMENTS),
    metric: str = "mae",
) -> ExperimentResult:
    """Fit the fixed experiments on train, grade them on validation and test, pick one.

    Predictions of all experiments are one long table, graded in one pass per report.
    """
    df = durable(df)
    train = df.where("split = 'train'")
    graded = df.where("split in ('validation', 'test')")
    models, long, shared = {}, None, {}
    for name in names:
        models[name] = EXPERIMENTS[name](train, config, shared)
        part = predict(models[name], graded).select(
            F.lit(name).alias("experiment"), "split", "mode", F.col("min_delay").alias("actual"), "prediction"
        )
        long = part if long is None else long.unionByName(part)
    long = with_residuals(durable(long))
    result = ExperimentResult(
        metrics.extended_metrics(long, ["experiment", "split"]),
        metrics.extended_metrics(long, ["experiment", "split", "mode"]),
        high_delay(long, ["experiment", "split"]),
        None,
        models,
    )
    result.selected = metrics.pick_experiment(result.metrics, result.high_delay, result.by_mode, metric)
    return result


# --- severe-delay risk ----------------------------------------------------------------------


def fit_classifier(
    train: DataFrame, threshold: int, config: TreeConfig = CLASSIFIER, target: str = "min_delay", shared: dict | None = None
) -> PipelineModel:
    """Boosted trees for ``target >= threshold``; positives weigh negatives / positives."""
    features, categoricals, numerics = feature_projection(train.columns)
    rows = training_rows(train, features, target).withColumn(
        "_label", (F.col(target) >= threshold).cast("double")
    )
    positives, negatives = rows.agg(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") == 0)).first()
    if not positives or not negatives:
        raise ValueError(f"Cannot train a risk classifier for {target} >= {threshold}: both classes are needed.")
    weight = F.when(F.col("_label") == 1, negatives / positives).otherwise(1.0)
    rows = rows.withColumn("_weight", weight)
    prepared = prepared_for(rows, categoricals, numerics, config, shared)
    return PipelineModel([*prepared.stages, _trees(prepared, rows, config, True)])


def positive_probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    out = out.withColumn(name, vector_to_array("probability")[1])
    return out.drop("probability", *_helper_columns(out))


@dataclass
class Calibrator:
    """Maps a base probability to a calibrated one."""

    method: str
    model: LogisticRegressionModel | IsotonicRegressionModel | None = None

    def transform(self, df: DataFrame, source: str, name: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.col(source))
        if self.method == "sigmoid":
            slope, offset = float(self.model.coefficients[0]), float(self.model.intercept)
            return df.withColumn(name, 1.0 / (1.0 + F.exp(-(F.col(source) * slope + offset))))
        scored = self.model.transform(df.withColumn("_score", F.col(source)))
        limited = F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0))
        return scored.withColumn(name, limited).drop("_score", "_calibrated")


def fit_calibrators(scored: DataFrame, probability: str, label: str) -> dict[str, Calibrator]:
    """Sigmoid and isotonic maps, fitted on the distinct scores with their weights.

    The sigmoid uses smoothed targets: (P + 1) / (P + 2) for positives, 1 / (N + 2) for negatives.
    """
    points = scored.groupBy(F.col(probability).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")
    ).persist()
    positives, negatives = points.agg(F.sum("_p"), F.sum("_n")).first()
    if not positives or not negatives:
        raise ValueError("Cannot calibrate: the calibration rows must contain both classes.")
    high, low = (positives + 1.0) / (positives + 2.0), 1.0 / (negatives + 2.0)
    sides = F.array(
        F.struct(F.lit(1.0).alias("_label"), (F.col("_p") * high + F.col("_n") * low).alias("_weight")),
        F.struct(F.lit(0.0).alias("_label"), (F.col("_p") * (1 - high) + F.col("_n") * (1 - low)).alias("_weight")),
    )
    soft = points.select(array_to_vector(F.array("_score")).alias("features"), F.inline(sides))
    sigmoid = LogisticRegression(labelCol="_label", weightCol="_weight", maxIter=100, standardization=False).fit(soft)
    steps = points.select(
        "_score", (F.col("_p") / (F.col("_p") + F.col("_n"))).alias("_label"),
        (F.col("_p") + F.col("_n")).cast("double").alias("_weight"),
    )
    isotonic = IsotonicRegression(
        featuresCol="_score", labelCol="_label", weightCol="_weight", predictionCol="_calibrated"
    ).fit(steps)
    points.unpersist()
    return {
        "uncalibrated": Calibrator("uncalibrated"),
        "sigmoid": Calibrator("sigmoid", sigmoid),
        "isotonic": Calibrator("isotonic", isotonic),
    }


@dataclass
class RiskModel:
    """One threshold: base classifier, chosen calibrator and cutoff."""

    threshold: int
    base: PipelineModel
    calibrator: Calibrator
    cutoff: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.threshold
        name = f"calibrated_severe_delay_probability_{t}"
        out = positive_probability(self.base, df, "_base")
        out = self.calibrator.transform(out, "_base", name).drop("_base")
        out = out.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)))
        return out.withColumns(
            {
                f"risk_band_{t}": risk_band(F.col(name), CALIBRATED_BANDS),
                f"severe_delay_prediction_{t}": (F.col(name) >= self.cutoff).cast("int"),
                f"selected_probability_cutoff_{t}": F.lit(self.cutoff),
                f"calibration_method_{t}": F.lit(self.calibrator.method),
            }
        )


@dataclass
class Artifact:
    """Everything scoring needs: delay regressor, risk models, feature list."""

    regressor: PipelineModel | ModeModels
    risks: dict[int, RiskModel]
    features: list[str]
    target: str = "min_delay"

    def save(self, path: str, spark: SparkSession) -> None:
        modes = list(self.regressor.models) if isinstance(self.regressor, ModeModels) else []
        parts = self.regressor.models if modes else {"all": self.regressor}
        for name, model in parts.items():
            model.write().overwrite().save(f"{path}/regressor/{name}")
        for t, risk in self.risks.items():
            risk.base.write().overwrite().save(f"{path}/risk_{t}/base")
            if risk.calibrator.model is not None:
                risk.calibrator.model.write().overwrite().save(f"{path}/risk_{t}/calibrator")
        settings = {
            "expected_delay_regressor": modes or ["all"],
            "calibrated_risk_classifiers": {
                str(t): {"method": r.calibrator.method, "cutoff": r.cutoff} for t, r in self.risks.items()
            },
            "feature_columns": self.features,
            "target_column": self.target,
        }
        line = spark.createDataFrame([(json.dumps(settings),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/settings")


REQUIRED_SETTINGS = ["expected_delay_regressor", "calibrated_risk_classifiers", "feature_columns", "target_column"]


def load_artifact(path: str, spark: SparkSession) -> Artifact:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    missing = sorted(set(REQUIRED_SETTINGS) - set(settings))
    if missing:
        raise ValueError(f"Model artifact is missing required key(s): {missing}.")
    names = settings["expected_delay_regressor"]
    parts = {name: PipelineModel.load(f"{path}/regressor/{name}") for name in names}
    kinds = {"sigmoid": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}
    risks = {}
    for key, entry in settings["calibrated_risk_classifiers"].items():
        kind = kinds.get(entry["method"])
        model = kind.load(f"{path}/risk_{key}/calibrator") if kind else None
        risks[int(key)] = RiskModel(
            int(key), PipelineModel.load(f"{path}/risk_{key}/base"), Calibrator(entry["method"], model), entry["cutoff"]
        )
    regressor = parts["all"] if names == ["all"] else ModeModels(parts)
    return Artifact(regressor, risks, settings["feature_columns"], settings["target_column"])


def two_output_frame(df: DataFrame, artifact: Artifact, carried: Sequence[str] = ()) -> DataFrame:
    """Row-level delay and risk predictions with pass-through (and ``carried``) columns."""
    out = predict(artifact.regressor, df).withColumnRenamed("prediction", "predicted_delay_minutes")
    for risk in artifact.risks.values():
        out = risk.transform(out)
    kept = [c for c in out.columns if c not in df.columns]
    # A pass-through column that misses is NULL text.
    names = [first_present(out, name, candidates) for name, candidates in PASS_THROUGH.items()]
    split = [F.col("split")] if "split" in df.columns else []
    more = [F.col(c) for c in carried if c not in PASS_THROUGH and c != "split"]
    return out.select(*split, F.col(artifact.target).alias("actual_delay"), *names, *kept, *more)


def plain_risk_frame(df: DataFrame, classifiers: Mapping[int, PipelineModel]) -> DataFrame:
    """Uncalibrated probabilities with the wider bands."""
    out = df
    for t, model in classifiers.items():
        name = f"severe_delay_probability_{t}"
        out = positive_probability(model, out, name)
        out = out.withColumn(f"risk_band_{t}", risk_band(F.col(name), PLAIN_BANDS))
    return out


@dataclass
class CalibrationResult:
    metrics: DataFrame
    cutoffs: DataFrame
    bins: DataFrame
    bands: DataFrame
    risks: dict[int, RiskModel]
    selections: DataFrame
    scored: DataFrame


def run_calibration(
    df: DataFrame, calibration_start: str, calibration_end: str, config: TreeConfig = CLASSIFIER,
    thresholds: Sequence[int] = tuple(SEVERE_THRESHOLDS),
) -> CalibrationResult:
    """Base fit before the calibration year, maps fitted in it, choices made on validation only.

    All (split, threshold, method) scores form one long table; every report is one aggregation
    over it, instead of one per combination.
    """
    df = durable(df)
    train = check_calibration_split(df.where("split = 'train'"), calibration_start, calibration_end)
    base_rows = train.where("calibration_split = 'base'").drop("calibration_split")
    held = train.where("calibration_split = 'calibration'").drop("calibration_split")
    held = held.withColumn("split", F.lit("calibration"))
    graded = held.unionByName(df.where("split in ('validation', 'test')"))
    bases, maps, long, shared = {}, {}, None, {}
    for t in thresholds:
        bases[t] = fit_classifier(base_rows, t, config, shared=shared)
        scored = positive_probability(bases[t], graded, "_p").select(
            "split", F.lit(t).alias("threshold_minutes"), (F.col("min_delay") >= t).cast("int").alias("y"), "_p"
        )
        maps[t] = fit_calibrators(scored.where("split = 'calibration'"), "_p", "y")
        for method, calibrator in maps[t].items():
            part = calibrator.transform(scored, "_p", "p").select(
                "split", "threshold_minutes", F.lit(method).alias("calibration_method"), "y", "p"
            )
            long = part if long is None else long.unionByName(part)
    # Read by five reports below.
    long = durable(long)
    by = ["split", "threshold_minutes", "calibration_method"]
    choice = ["threshold_minutes", "calibration_method"]
    cutoffs = metrics.cutoff_table(long.where("split = 'validation'"), by, "y", "p", CALIBRATION_CUTOFFS)
    picked = metrics.pick_cutoff(cutoffs, choice)
    at = long.join(F.broadcast(picked.select(*choice, "probability_cutoff")), choice)
    hit = F.col("p") >= F.col("probability_cutoff")
    counts = at.groupBy(*by).agg(
        F.max("probability_cutoff").alias("selected_probability_cutoff"),
        F.count_if(hit & (F.col("y") == 1)).alias("true_positives"),
        F.count_if(hit & (F.col("y") != 1)).alias("false_positives"),
        F.count_if(~hit & (F.col("y") != 1)).alias("true_negatives"),
        F.count_if(~hit & (F.col("y") == 1)).alias("false_negatives"),
        *[m.alias(n) for n, m in metrics.probability_losses("y", "p").items()],
    )
    report = metrics.confusion_ratios(counts)
    report = report.join(metrics.rank_metrics(long, by, "y", "p"), by, "left")
    report = report.join(metrics.expected_calibration_error(long, by, "y", "p"), by, "left")
    selections = metrics.pick_calibration(report.where("split = 'validation'"), ["threshold_minutes"])
    chosen = selections.collect()  # one line per threshold
    risks = {
        row["threshold_minutes"]: RiskModel(
            row["threshold_minutes"], bases[row["threshold_minutes"]],
            maps[row["threshold_minutes"]][row["calibration_method"]], row["selected_probability_cutoff"],
        )
        for row in chosen
    }
    return CalibrationResult(
        report, cutoffs, metrics.reliability_bins(long, by, "y", "p"),
        metrics.band_summary(long, by, "y", "p"), risks, selections, long,
    )
