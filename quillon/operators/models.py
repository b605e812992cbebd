"""Scorers of pairs: boosted trees from pyspark.ml, their mean, calibration, hard examples; and a plain rule score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.collective import logit
from quillon.operators.decision import fold
from quillon.operators.profiling import log_loss

MISSING = -1.0
GROUPS = {"name": ("name_", "legal_"), "address": ("address_",), "number": ("number_", "long_number", "name_number"), "blocking": ("blocked_", "blocking_", "hybrid_", "candidates_"), "cross_field": ("cross_",), "country_missing": ("country_", "missing_")}


def feature_columns(df: DataFrame, label: str = "label") -> list[str]:
    return [c for c in df.columns if c not in ("q", "r", label, "weight", "dev", "p")]


def select_groups(columns: Sequence[str], groups: Sequence[str]) -> list[str]:
    prefixes = tuple(p for g in groups for p in GROUPS[g])
    return [c for c in columns if c.startswith(prefixes)]


def not_constant(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Features with two values or more, missing being one; found in one pass."""
    row = df.agg(*(F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("n")).alias(c) for c in columns), F.count("*").alias("__rows")).first()
    return [c for c in columns if row[c].a != row[c].b or 0 < row[c].n < row["__rows"]]


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing features as MISSING: the trees take no nulls."""
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) if c in columns else F.col(c) for c in df.columns))


def boosted(columns: Sequence[str], label: str = "label", trees: int = 40, depth: int = 5, step: float = 0.1, dev: str | None = None, weight: str | None = None) -> Pipeline:
    options = {"validationIndicatorCol": dev} if dev else {}
    options |= {"weightCol": weight} if weight else {}
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=1, **options)])


def forest(columns: Sequence[str], label: str = "label", trees: int = 60, depth: int = 8, weight: str | None = None) -> Pipeline:
    options = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, seed=1, **options)])


def boosted_sampled(columns: Sequence[str], label: str = "label", trees: int = 40, depth: int = 6, step: float = 0.1, dev: str | None = None, weight: str | None = None) -> Pipeline:
    """A second boosted ensemble, deeper, each tree on 0.8 of the rows and of the features at each split."""
    options = {"validationIndicatorCol": dev} if dev else {}
    options |= {"weightCol": weight} if weight else {}
    model = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), model])


def save(models: Sequence[PipelineModel], columns: Sequence[str], path: str) -> None:
    """The ensemble's members and the columns they read, so that scoring can be another run than training."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/member-{i}")
    SparkSession.active().createDataFrame([(len(models), list(columns))], "members int, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[list[PipelineModel], list[str]]:
    """What save() wrote: members and columns, as predict() takes them."""
    about = spark.read.schema("members int, columns array<string>").json(f"{path}/about").first()
    return [PipelineModel.load(f"{path}/member-{i}") for i in range(about.members)], list(about.columns)


#: The experiments' feature groups (None: all), weighting, ensemble and calibration.
EXPERIMENTS = {
    "M001_all_weighted": (None, True, "boosted", None),
    "M002_all_hardneg_unweighted": (None, False, "boosted", None),
    "M003_name_only": (("name",), True, "boosted", None),
    "M004_name_address": (("name", "address", "cross_field"), True, "boosted", None),
    "M005_name_address_numeric": (("name", "address", "cross_field", "number"), True, "boosted", None),
    "M006_all_but_blocking": (("name", "address", "cross_field", "number", "country_missing"), True, "boosted", None),
    "M007_all_weighted_isotonic": (None, True, "boosted", "isotonic"),
    "M008_sampled_all_weighted": (None, True, "sampled", None),
}


def experiments(train: DataFrame, dev: DataFrame, columns: Sequence[str], names: Sequence[str] = tuple(EXPERIMENTS), label: str = "label", **size) -> DataFrame:
    """experiment, features, log_loss, auc on dev of each model; train has a weight. An experiment without features is left out."""
    out = []
    for name in names:
        groups, weighted, kind, calibration = EXPERIMENTS[name]
        own = not_constant(train, select_groups(columns, groups) if groups else columns)
        if not own:
            continue
        make = boosted if kind == "boosted" else boosted_sampled
        members = fit(train, own, [make(own, label, weight="weight" if weighted else None, **size)])
        scored = predict(dev, own, members)
        if calibration:
            scored = Calibrator(calibration).fit(predict(train, own, members), label=label).transform(scored, name="p")
        loss = log_loss(scored, "p", label).first().log_loss
        out.append((name, len(own), float(loss), float(auc(scored, "p", label))))
    return train.sparkSession.createDataFrame(out, "experiment string, features int, log_loss double, auc double")


def auc(df: DataFrame, p: str, label: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=label).evaluate(df)


def fit(df: DataFrame, columns: Sequence[str], members: Sequence[Pipeline]) -> list[PipelineModel]:
    data = filled(df, columns)
    return [m.fit(data) for m in members]


def predict(df: DataFrame, columns: Sequence[str], models: Sequence[PipelineModel], name: str = "p") -> DataFrame:
    """Adds the mean of the members' probabilities."""
    out = filled(df, columns)
    keep, parts = [F.col(c) for c in df.columns if c != name], []
    for i, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")
        parts.append(F.col(f"__p{i}"))
    return out.select(*keep, (sum(parts[1:], parts[0]) / len(parts)).alias(name))


def importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(columns, (float(x) for x in model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


class Calibrator:
    """Isotonic regression, or Platt's logistic regression on the logit."""

    def __init__(self, method: str = "isotonic"):
        self.method = method

    def fit(self, df: DataFrame, p: str = "p", label: str = "label") -> Calibrator:
        rows = df.select(F.col(p).alias("__p"), logit(F.col(p)).alias("__l"), F.col(label).cast("double").alias("__y"))
        if self.method == "isotonic":
            self.model = IsotonicRegression(featuresCol="__p", labelCol="__y").fit(rows)
        else:
            data = VectorAssembler(inputCols=["__l"], outputCol="__x").transform(rows)
            m = LogisticRegression(featuresCol="__x", labelCol="__y").fit(data)
            self.a, self.b = float(m.coefficients[0]), float(m.intercept)
        return self

    def transform(self, df: DataFrame, p: str = "p", name: str = "calibrated") -> DataFrame:
        if self.method == "isotonic":
            out = self.model.transform(df.withColumn("__p", F.col(p)))
            return out.withColumn(name, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))).drop("prediction", "__p")
        return df.withColumn(name, 1 / (1 + F.exp(-(self.a * logit(F.col(p)) + self.b))))


def hard_examples(df: DataFrame, columns: Sequence[str], label: str = "label", folds: int = 2) -> DataFrame:
    """q, r, p, label of pairs that a quick model fitted on the other folds gets wrong."""
    rows = df.withColumn("__f", fold(F.col("q"), "hard", folds))
    out = None
    for k in range(folds):
        models = fit(rows.where(F.col("__f") != k).drop("__f"), columns, [boosted(columns, label, trees=10, depth=4)])
        part = predict(rows.where(F.col("__f") == k).drop("__f"), columns, models).select("q", "r", "p", label)
        out = part if out is None else out.unionByName(part)
    return out.where(((F.col(label) == 0) & (F.col("p") >= 0.5)) | ((F.col(label) == 1) & (F.col("p") < 0.5)))


def with_hard_examples(sample: DataFrame, hard: DataFrame, boost: float = 3.0) -> DataFrame:
    """The sample's weights, those of hard pairs multiplied."""
    marks = hard.select("q", "r", F.lit(boost).alias("__boost"))
    return sample.join(marks, ["q", "r"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)) * F.coalesce("__boost", F.lit(1.0))).drop("__boost")


def rule_score(name: Column, address: Column, exact: Column, idf: Column) -> Column:
    """A score without training: weighted evidence, rounded to six places."""
    n, a = F.coalesce(name, F.lit(0.0)), F.coalesce(address, F.lit(0.0))
    return F.round(0.35 * n + 0.3 * a + 0.2 * F.coalesce(exact, F.lit(0.0)) + 0.15 * F.coalesce(idf, F.lit(0.0)), 6)


