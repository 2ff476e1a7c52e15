"""The models as ``pyspark.ml`` estimators, so that pipelines, parameter grids and cross-validation take them.

Every constructor argument of the wrapped model is a Param of the same name; columns are the Params ``features``, ``time``, ``event``
and ``prediction``. A fitted stage keeps the model as ``fitted`` and adds its prediction: the risk of a forest, the linear predictor of a regression.
Stages, fitted or not, and pipelines of them are saved and loaded like any other: params as metadata, models as Parquet tables.
"""

from __future__ import annotations

import inspect

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from .operators.concordance import concordance_index_cr
from .operators.forest import CompetingRiskForest
from .operators.regression import CauseSpecificCox, FineGrayRegression, PenalizedFineGrayRegression


class _Columns(Params):
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    time = Param(Params._dummy(), "time", "time column", TypeConverters.toString)
    event = Param(Params._dummy(), "event", "event column", TypeConverters.toString)
    prediction = Param(Params._dummy(), "prediction", "column of the prediction", TypeConverters.toString)


class _Stage(_Columns, Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """An estimator around one model class; settings not named keep the class's defaults."""

    wraps: type

    def __init__(self, **settings):
        super().__init__()
        for name, argument in inspect.signature(self.wraps.__init__).parameters.items():
            if name != "self":
                setattr(self, name, Param(self, name, f"{name} of {self.wraps.__name__}"))
                self._setDefault(**{name: argument.default})
        self._setDefault(time="time", event="event", prediction="prediction")
        self._set(**settings)

    def _fit(self, df: DataFrame) -> FittedStage:
        own = {n: self.getOrDefault(n) for n in inspect.signature(self.wraps.__init__).parameters if n != "self"}
        fitted = self.wraps(**own).fit(df, self.getOrDefault("features"), self.getOrDefault("time"), self.getOrDefault("event"))
        return self._copyValues(FittedStage(fitted))


class FittedStage(_Columns, Model, MLWritable, MLReadable):
    """A fitted model; ``transform`` adds its prediction."""

    def __init__(self, fitted=None):
        super().__init__()
        self._setDefault(prediction="prediction")
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getOrDefault("prediction")
        if isinstance(self.fitted, CompetingRiskForest):
            return self.fitted.predict_risk(df, self.fitted.cause, name=name)
        return self.fitted.predict(df, name)

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader()


_MODELS = {m.__name__: m for m in (CompetingRiskForest, FineGrayRegression, CauseSpecificCox, PenalizedFineGrayRegression)}


class _FittedWriter(MLWriter):
    """Params and the model's class by name as metadata; the model's own tables beside them."""

    def __init__(self, stage: FittedStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"model": type(self.stage.fitted).__name__})
        fitted = self.stage.fitted
        fitted.save(f"{path}/fitted") if isinstance(fitted, CompetingRiskForest) else fitted.save(self.sparkSession, f"{path}/fitted")


class _FittedReader(MLReader):
    def load(self, path: str) -> FittedStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        if metadata["model"] not in _MODELS:
            raise ValueError(f"unknown model {metadata['model']!r}")
        stage = FittedStage(_MODELS[metadata["model"]].load(self.sparkSession, f"{path}/fitted"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class ForestStage(_Stage):
    wraps = CompetingRiskForest


class FineGrayStage(_Stage):
    wraps = FineGrayRegression


class CauseSpecificCoxStage(_Stage):
    wraps = CauseSpecificCox


class PenalizedFineGrayStage(_Stage):
    wraps = PenalizedFineGrayRegression


class ConcordanceEvaluator(_Columns, Evaluator, DefaultParamsWritable, DefaultParamsReadable):
    """Cause-specific concordance of a prediction; larger is better."""

    cause = Param(Params._dummy(), "cause", "cause of interest", TypeConverters.toInt)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(time="time", event="event", prediction="prediction", cause=1)
        self._set(**settings)

    def _evaluate(self, df: DataFrame) -> float:
        return concordance_index_cr(df, self.getOrDefault("cause"), self.getOrDefault("event"), self.getOrDefault("time"), self.getOrDefault("prediction"))
