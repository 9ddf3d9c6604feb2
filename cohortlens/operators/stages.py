"""Pipeline stages of this library, saved and loaded like MLlib's own (survey A6, F2, H1, I1).

MLlib has no stage that fills nulls with a constant for any numeric column, scales by the population deviation,
holds given centres or given coefficients. These do, as ``Transformer``, ``Estimator`` and ``Model``
classes with MLlib's parameter files, so a fitted ``PipelineModel`` that begins with them scores raw rows,
and a saved one scores them alike after loading. All transform with column expressions on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.features import apply_zscore, fit_zscore, to_array


class _Stage(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns in, as many columns out; without output names the columns are replaced."""

    def outputs(self) -> list[str]:
        return self.getOutputCols() if self.isSet(self.outputCols) else self.getInputCols()


class NullFiller(Transformer, _Stage):
    """Numeric columns as doubles, null and NaN replaced by ``value``; other columns stay."""

    value = Param(Params._dummy(), "value", "what stands for a missing number", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, value=0.0):
        super().__init__()
        self._setDefault(value=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = F.lit(self.getOrDefault(self.value))
        number = {o: F.col(f"`{c}`").cast("double") for c, o in zip(self.getInputCols(), self.outputs(), strict=True)}
        return dataset.withColumns({o: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), value) for o, x in number.items()})


class PopulationScaler(Estimator, _Stage):
    """Learns means and population deviations (a zero or missing one counts as 1); nulls are left out."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        stats = fit_zscore(dataset, cols)
        model = PopulationScalerModel(means=[float(stats[c][0]) for c in cols], deviations=[float(stats[c][1]) for c in cols])
        return self._copyValues(model)


class PopulationScalerModel(Model, _Stage):
    """(x - mean) / population deviation, column by column."""

    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.outputs()
        stats = dict(zip(ins, zip(self.getOrDefault(self.means), self.getOrDefault(self.deviations), strict=True), strict=True))
        if ins == outs:
            return apply_zscore(dataset, stats)
        return dataset.withColumns({o: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c, o in zip(ins, outs, strict=True)})


class CentreModel(Model, HasInputCols, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The nearest of given centres (by squared distance, the first of equals) as an int column.

    Points are ``inputCols``, or one array or vector column ``pointCol``."""

    centres = Param(Params._dummy(), "centres", "all centres, one after another", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "coordinates of a centre", TypeConverters.toInt)
    pointCol = Param(Params._dummy(), "pointCol", "array or vector column with the coordinates", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, pointCol=None, centres=None, width=None, predictionCol="prediction"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, centres: np.ndarray, features: str | Sequence[str]) -> CentreModel:
        model = cls(centres=np.asarray(centres, float).ravel().tolist(), width=int(np.shape(centres)[1]))
        return model._set(pointCol=features) if isinstance(features, str) else model._set(inputCols=list(features))

    def clusterCenters(self) -> list[np.ndarray]:
        return list(np.array(self.getOrDefault(self.centres)).reshape(-1, self.getOrDefault(self.width)))

    def setPredictionCol(self, value: str) -> CentreModel:
        return self._set(predictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = to_array(dataset, self.getOrDefault(self.pointCol) if self.isSet(self.pointCol) else self.getInputCols(), "__x")
        point = [F.col("__x")[i] for i in range(self.getOrDefault(self.width))]
        squares = [sum(((x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(point, c, strict=True)), F.lit(0.0)) for c in self.clusterCenters()]
        near = (F.array_position("__d", F.array_min("__d")) - 1).cast("int")
        return rows.withColumn("__d", F.array(*squares)).withColumn(self.getPredictionCol(), near).drop("__d", "__x")


class LinearPredictor(Model, HasInputCols, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """intercept + sum of coefficient times column."""

    coefficients = Param(Params._dummy(), "coefficients", "one for each input column", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "the constant", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, coefficients=None, intercept=None, predictionCol="prediction"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms = [F.col(f"`{c}`").cast("double") * F.lit(w) for c, w in zip(self.getInputCols(), self.getOrDefault(self.coefficients), strict=True)]
        return dataset.withColumn(self.getPredictionCol(), sum(terms, F.lit(self.getOrDefault(self.intercept))))


def fit_preparation(train: DataFrame, features: Sequence[str], value: float = 0.0, scale: bool = True) -> PipelineModel:
    """Stages that make raw rows ready for a model: nulls filled, then (``scale``) z-scores by the statistics of ``train``."""
    filler = NullFiller(inputCols=list(features), value=float(value))
    if not scale:
        return PipelineModel([filler])
    scaler = PopulationScaler(inputCols=list(features)).fit(filler.transform(train))
    return PipelineModel([filler, scaler])


def chain(*parts: Transformer) -> PipelineModel:
    """Fitted stages and pipelines, one after another, as one ``PipelineModel``."""
    stages = [s for p in parts for s in (p.stages if isinstance(p, PipelineModel) else [p])]
    return PipelineModel(stages)


def feature_names(model: PipelineModel) -> list[str]:
    """The feature list a saved pipeline was fitted on."""
    for s in model.stages:
        if isinstance(s, (NullFiller, VectorAssembler, CentreModel, LinearPredictor)):
            return list(s.getInputCols())
    raise ValueError("the pipeline has no stage that names its features")
