"""The three candidate models, and scorers that add ``p`` to scaled rows."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.risk import hard_class, logistic
from riskloom.operators.boosting import BoostedTrees, Boosting, fit_trees
from riskloom.operators.weights import with_balanced_weight, with_positive_weight
from riskloom.schema import FEATURES, KEY, LABEL
from riskloom.storage import small_frame

LOGISTIC = "Logistic Regression"
FOREST = "Random Forest"
BOOSTED = "Gradient Boosted Trees"
MODEL_NAMES = [LOGISTIC, FOREST, BOOSTED]

# Training settings.
MAX_ITER = 1000
TREES, FOREST_DEPTH = 200, 12
ROUNDS, BOOST_DEPTH, LEARNING_RATE, ROW_SHARE, COLUMN_SHARE = 300, 6, 0.05, 0.8, 0.8
POSITIVE_WEIGHT = 100.0
SEED = 42

_COMMON = {"featuresCol": "features", "labelCol": LABEL, "weightCol": "weight"}


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def fit_logistic(train: DataFrame):
    """Balanced logistic regression. A penalty of 1 on the summed loss is 1/sum(w) on the mean."""
    weighted = with_balanced_weight(train)
    total = weighted.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        maxIter=MAX_ITER, standardization=False, elasticNetParam=0.0, regParam=1.0 / total, **_COMMON
    ).fit(weighted)


def fit_forest(train: DataFrame, trees: int = TREES):
    return RandomForestClassifier(
        numTrees=trees, maxDepth=FOREST_DEPTH, seed=SEED, cacheNodeIds=True, checkpointInterval=10, **_COMMON
    ).fit(with_balanced_weight(train))


def fit_boosted(train: DataFrame, rounds: int = ROUNDS) -> BoostedTrees:
    """Second-order boosting, columns drawn per tree, positives weighted."""
    settings = Boosting(rounds, BOOST_DEPTH, LEARNING_RATE, ROW_SHARE, COLUMN_SHARE, seed=SEED)
    return fit_trees(with_positive_weight(train, POSITIVE_WEIGHT), settings)


def candidates(trees: int = TREES, rounds: int = ROUNDS) -> dict:
    """Name to fit function, in the order that breaks ties."""
    return {
        LOGISTIC: fit_logistic,
        FOREST: lambda train: fit_forest(train, trees),
        BOOSTED: lambda train: fit_boosted(train, rounds),
    }


def importance(model, n: int = 15) -> DataFrame | None:
    """``feature, importance`` of the ``n`` strongest features; None for a model without them."""
    weights = getattr(model, "featureImportances", None)
    if weights is None:
        return None
    rows = list(zip(FEATURES, [float(w) for w in weights.toArray()]))
    df = small_frame(SparkSession.active(), rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


@dataclass
class ModelScorer:
    """P(class 1) of a fitted pipeline whose first stage assembles the features."""

    model: PipelineModel

    def __call__(self, scaled: DataFrame) -> DataFrame:
        scored = self.model.transform(scaled)
        p = vector_to_array("probability")[1]
        return scored.withColumn("p", p).select(*scaled.columns, "p", F.col("prediction").cast("int"))


@dataclass
class FixedLogit:
    """A logistic model with known coefficients, as a plain column expression."""

    intercept: float
    coefficients: dict[str, float]

    def __call__(self, scaled: DataFrame) -> DataFrame:
        terms = [f"{float(weight)!r}D * `{c}`" for c, weight in self.coefficients.items()]
        z = F.expr(" + ".join([f"{float(self.intercept)!r}D", *terms]))
        return scaled.withColumn("p", logistic(z)).withColumn("prediction", hard_class(F.col("p")))


def scorer_for(model: PipelineModel | BoostedTrees) -> Callable[[DataFrame], DataFrame]:
    """The cheapest scorer with the model's probabilities: a logistic model needs no vectors."""
    if isinstance(model, BoostedTrees):
        return model
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        return FixedLogit(last.intercept, dict(zip(FEATURES, map(float, last.coefficients))))
    return ModelScorer(model)


def compare(scaled: DataFrame, scorers: dict[str, Callable]) -> DataFrame:
    """``model, <key>, Class, p, prediction`` for several scorers over one pass of the rows."""
    kept = [c for c in (KEY, LABEL) if c in scaled.columns]
    wide, results = scaled, []
    for i, (name, scorer) in enumerate(scorers.items()):
        wide = scorer(wide).withColumnsRenamed({"p": f"_p{i}", "prediction": f"_prediction{i}"})
        results.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col(f"_p{i}").alias("p"),
                F.col(f"_prediction{i}").alias("prediction"),
            )
        )
    return wide.select(*kept, F.inline(F.array(*results))).select("model", *kept, "p", "prediction")


def as_pipeline(model) -> PipelineModel | BoostedTrees:
    """What is saved and scored with: boosted trees take the features as they are."""
    return model if isinstance(model, BoostedTrees) else PipelineModel([assembler(), model])
