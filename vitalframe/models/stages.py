"""Classifiers as stages of a Spark ML pipeline: they are fitted, saved, loaded and chained like any other stage."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.models.learned import TrainedModel, etiology_vector, usable
from vitalframe.operators.classify import summarise_posteriors, table_classifier


class GaussianPosteriors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Posteriors of a feature table under class parameters that are saved with the stage.

    ``parameters`` is JSON: ``gaussian`` (class, feature, mean, std), ``grip`` and ``prior`` rows (class, name, probability).
    """

    parameters = Param(Params._dummy(), "parameters", "class parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, parameters: str | None = None):
        super().__init__()
        self._setDefault(parameters=default_parameters())
        if parameters is not None:
            self._set(parameters=parameters)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, held = dataset.sparkSession, json.loads(self.getOrDefault(self.parameters))
        bells = spark.createDataFrame([tuple(r) for r in held["gaussian"]], "class string, feature string, mean double, std double")
        shares = [(cls, kind, name, p) for kind in ("grip", "prior") for cls, name, p in held[kind]]
        return table_classifier(bells, spark.createDataFrame(shares, "class string, kind string, name string, probability double"))(dataset)


def default_parameters() -> str:
    return json.dumps(
        {
            "gaussian": [(cls, f, *pair) for cls in C.CLASSES for f, pair in C.GAUSSIAN[cls].items()],
            "grip": [(cls, g, p) for cls in C.CLASSES for g, p in C.GRIP[cls].items()],
            "prior": [(cls, name, table[cls]) for name, table in (("usual", C.PRIOR), ("tonic", C.PRIOR_TONIC)) for cls in C.CLASSES],
        }
    )


class EtiologyVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The nine inputs of the etiology model as the vector ``_vector``; zeros where one is missing (see ``ModelPosteriors``)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = etiology_vector(dataset)
        blank = F.array(*[F.lit(0.0)] * 9)
        return rows.withColumn("_usable", usable()).withColumn("_vector", array_to_vector(F.when(F.col("_usable"), F.col("features")).otherwise(blank))).drop("features")


class ModelPosteriors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model's probability vector as posterior columns; classes it never saw get zero, rows without inputs null."""

    classes = Param(Params._dummy(), "classes", "classes in the order of the vector", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, classes: list[str] | None = None):
        super().__init__()
        self._setDefault(classes=list(C.CLASSES))
        if classes is not None:
            self._set(classes=classes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        shares = dataset.withColumn("_prob", F.when(F.col("_usable"), vector_to_array("probability")))
        posteriors = {
            f"p_{cls.lower()}": F.get("_prob", F.lit(classes.index(cls))) if cls in classes else F.when(F.col("_usable"), F.lit(0.0))
            for cls in C.CLASSES
        }
        return summarise_posteriors(shares.withColumns(posteriors)).drop(
            "_prob", "probability", "rawPrediction", "prediction", "_vector", "_scaled", "_usable"
        )


def classifier_pipeline(model: TrainedModel | None = None) -> PipelineModel:
    """The Gaussian classifier, or a trained etiology model, as a pipeline from feature table to posterior columns."""
    if model is None:
        return PipelineModel([GaussianPosteriors()])
    return PipelineModel([EtiologyVector(), *model.model.stages, ModelPosteriors(classes=[str(c) for c in model.classes])])

