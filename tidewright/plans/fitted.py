"""Fitted models as pipeline stages that can be written and read: a scaler and the linear forecaster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import splits
from tidewright.operators.forecast import fit_dlinear, predict_dlinear


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose parameters are set by keywords; what is fitted is parameters too, so it is written with them."""

    def __init__(self, **values):
        super().__init__()
        self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class _Scaled(Params):
    columns = Param(Params._dummy(), "columns", "columns that are scaled", TypeConverters.toListString)


class Scaler(_Stage, _Scaled, Estimator):
    """Fits means and population stds of columns, of each its own (scope "channel") or of all together ("global"), on the training rows of `split`, if given."""

    scope = Param(Params._dummy(), "scope", "channel or global", TypeConverters.toString)
    split = Param(Params._dummy(), "split", "column of the split; empty for all rows", TypeConverters.toString)
    eps = Param(Params._dummy(), "eps", "least std, or what is added to it", TypeConverters.toFloat)

    def __init__(self, columns: Sequence[str] = (), scope: str = "channel", split: str = "", eps: float = 1e-8):
        super().__init__(columns=list(columns), scope=scope, split=split, eps=eps)

    def _fit(self, df: DataFrame) -> ScalerModel:
        names, split = self.value("columns"), self.value("split")
        train = df.where(splits.in_split(F.col(split), "train")) if split else df
        fit = {"channel": splits.fit_channel_scaler, "global": splits.fit_global_scaler}[self.value("scope")]
        row = fit(train, names, self.value("eps")).first()
        if any(row[f"mean_{c}"] is None for c in names):
            raise ValueError("a column without a value can't be scaled")
        return ScalerModel(names, [row[f"mean_{c}"] for c in names], [row[f"std_{c}"] for c in names])


class ScalerModel(_Stage, _Scaled, Model):
    """Columns less their mean, divided by their std."""

    means = Param(Params._dummy(), "means", "means of the columns", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "what the columns are divided by", TypeConverters.toListFloat)

    def __init__(self, columns: Sequence[str] = (), means: Sequence[float] = (), stds: Sequence[float] = ()):
        super().__init__(columns=list(columns), means=list(means), stds=list(stds))

    def _each(self):
        return zip(self.value("columns"), self.value("means"), self.value("stds"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in self._each()})

    def inverse(self, df: DataFrame) -> DataFrame:
        """Columns back in their own units."""
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, m, s in self._each()})


class _Linear(Params):
    inputs = Param(Params._dummy(), "inputs", "values of an input window", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "values of a forecast", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "frame of the trend", TypeConverters.toInt)


class LinearForecaster(_Stage, _Linear, Estimator):
    """Fits linear maps from seasonal part and trend of windows (x) to their targets (y)."""

    ridge = Param(Params._dummy(), "ridge", "what is added to the diagonal", TypeConverters.toFloat)

    def __init__(self, inputs: int = 1, steps: int = 1, width: int = 1, ridge: float = 1e-3):
        super().__init__(inputs=inputs, steps=steps, width=width, ridge=ridge)

    def _fit(self, windows: DataFrame) -> LinearForecasterModel:
        n, steps, width = (self.value(p) for p in ("inputs", "steps", "width"))
        return LinearForecasterModel(n, steps, width, fit_dlinear(windows, n, steps, width, self.value("ridge")).ravel().tolist())


class LinearForecasterModel(_Stage, _Linear, Model):
    """Adds the forecast `pred` to windows (x)."""

    weights = Param(Params._dummy(), "weights", "weights row by row", TypeConverters.toListFloat)

    def __init__(self, inputs: int = 1, steps: int = 1, width: int = 1, weights: Sequence[float] = ()):
        super().__init__(inputs=inputs, steps=steps, width=width, weights=list(weights))

    def _transform(self, windows: DataFrame) -> DataFrame:
        shape = (2 * self.value("inputs") + 1, self.value("steps"))
        return predict_dlinear(windows, np.array(self.value("weights")).reshape(shape), self.value("width"))
