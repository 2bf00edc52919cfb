"""A stable split, and choosing the best model for a target column under a fixed budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import quoted
from millrace.operators.incremental import hash_number

TRAIN_PERCENT = 80  # fixed value
SEED = 42  # fixed value


def hash_split(df: DataFrame, key: str, percent: int = TRAIN_PERCENT, seed: int = SEED) -> DataFrame:
    """Add `is_train`, which depends on key and seed only, not on how rows are partitioned."""
    return df.withColumn("is_train", hash_number(F.lit(seed), quoted(key)) % 100 < percent)


@dataclass(frozen=True)
class Choice:
    name: str
    score: float
    model: PipelineModel


def default_grid() -> dict[str, object]:
    """Candidate classifiers; their number is the budget."""
    shared = {"featuresCol": "features", "labelCol": "label", "seed": SEED}
    linear = {k: v for k, v in shared.items() if k != "seed"}
    return {
        "linear_plain": LogisticRegression(maxIter=20, **linear),
        "linear_ridge": LogisticRegression(maxIter=20, regParam=0.1, **linear),
        "forest_shallow": RandomForestClassifier(numTrees=10, maxDepth=4, maxBins=128, **shared),
    }


def select_model(
    df: DataFrame,
    key: str,
    target: str,
    numeric: Sequence[str] = (),
    category: Sequence[str] = (),
    grid: dict[str, object] | None = None,
) -> list[Choice]:
    """Train every candidate on the training part, best area under the curve first."""
    rows = hash_split(df, key).withColumn("label", quoted(target).cast("double"))
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in category
    ]
    features = [*numeric, *[f"{c}_index" for c in category]]
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    evaluator = BinaryClassificationEvaluator(labelCol="label")
    prepare = Pipeline(stages=[*indexers, assembler]).fit(rows.where("is_train"))
    # every candidate reads the same features several times
    ready = prepare.transform(rows).select("features", "label", "is_train")
    ready.persist(StorageLevel.MEMORY_AND_DISK)
    train, valid = ready.where("is_train"), ready.where("not is_train")
    choices = []
    for name, candidate in (grid or default_grid()).items():
        model = candidate.fit(train)
        score = evaluator.evaluate(model.transform(valid))
        choices.append(Choice(name, score, PipelineModel([*prepare.stages, model])))
    ready.unpersist()
    return sorted(choices, key=lambda c: (-c.score, c.name))
