"""One run of a filter as an object: checked at once, planned lazily, its steps stored once, scores and windows from them."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.operators import metrics, sigma
from tidefold.operators.filters import ALL, COUNTS, filter_series
from tidefold.operators.kernels import build
from tidefold.operators.simulate import as_observations, simulate
from tidefold.plans import models
from tidefold.plans.models import Model
from tidefold.sources.files import read_table, save_steps, series_of
from tidefold.sources.scratch import scratch

LEVELS = (logging.WARNING, logging.INFO, logging.DEBUG)


@dataclass(frozen=True)
class RunOptions:
    """verbose: 0 to 2. save_history: steps stay below base_dir, in a folder for each model and method; else they are scratch. on_error: as of filter_series."""

    verbose: int = 0
    save_history: bool = False
    base_dir: str | None = None
    on_error: str = "raise"

    def __post_init__(self):
        if self.verbose not in range(len(LEVELS)):
            raise ParamError(f"verbose is 0 to {len(LEVELS) - 1}")
        if self.save_history and not self.base_dir:
            raise ParamError("save_history needs a base_dir")
        if self.on_error not in ("raise", "skip"):
            raise ParamError("on_error is raise or skip")


@dataclass
class Run:
    """A method on a model, over simulated series (steps), a file of X and Y columns, or a table of observations(...).

    All that can be wrong with names, numbers and options, and whether the method takes the model, is told when the run is
    made, before anything is read. Steps are computed when first asked for, written once, and read by all else.
    """

    method: str
    model: Model | str
    steps: int | None = None
    data: str | DataFrame | None = None
    series: int = 1
    seed: int = 42
    options: RunOptions = field(default_factory=RunOptions)
    parameters: dict[str, float] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if (self.steps is None) == (self.data is None):
            raise ParamError("give either steps or data")
        if self.steps is not None and (not isinstance(self.steps, int) or self.steps <= 0):
            raise ParamError("steps must be a positive integer")
        if not isinstance(self.series, int) or self.series <= 0:
            raise ParamError("series must be a positive integer")
        if isinstance(self.model, str):
            self.model = models.create(self.model, **self.parameters)
        elif self.parameters:
            raise ParamError("parameters are of a model that is named")
        if (key := self.settings.get("sigma_set")) is not None and key not in sigma.names():
            raise ParamError(f"there is no sigma set {key!r}; there are {', '.join(sigma.names())}")
        if (n := self.settings.get("n_particles")) is not None and (not isinstance(n, int) or n <= 0):
            raise ParamError("n_particles must be a positive integer")
        build(self.method, self.model, **self.settings)
        logging.getLogger("tidefold").setLevel(LEVELS[self.options.verbose])
        self._history: DataFrame | None = None

    @property
    def particles(self) -> bool:
        return self.method in ("pf", "ppf")

    def observations(self, spark: SparkSession) -> DataFrame:
        if self.steps is not None:
            return as_observations(simulate(spark, self.model, self.steps, self.series, self.seed))
        return series_of(read_table(spark, self.data), self.model.dim_x, self.model.dim_y) if isinstance(self.data, str) else self.data

    def history(self, spark: SparkSession) -> DataFrame:
        """Every step with all its columns, computed at the first call."""
        if self._history is None:
            plan = filter_series(self.observations(spark), self.model, self.method, output=(*ALL, *(COUNTS if self.particles else ())), on_error=self.options.on_error, **self.settings)
            path = self.options.base_dir if self.options.save_history else scratch(spark, "history")
            save_steps(plan, path, self.model.name, self.method)
            self._history = spark.read.schema(plan.schema).parquet(f"{path}/model={self.model.name}/method={self.method}")
        return self._history

    def clear(self) -> None:
        """The next call computes the steps again."""
        self._history = None

    def scores(self, spark: SparkSession, by: list[str] | None = None) -> DataFrame:
        """mse, mae, rmse, n, nees, and nis where the method has it; by series if asked. Rows without truth count for nees and mse no more than for n."""
        steps, by = self.history(spark), by or []
        plain = metrics.errors(steps, by)
        rows = metrics.with_nis(metrics.with_nees(steps.where("x_true is not null"), self.model.dim_x), self.model.dim_y)
        nis = F.avg("nis") if not self.particles else F.lit(None).cast("double")
        more = rows.groupBy(*by).agg(F.avg("nees").alias("nees"), nis.alias("nis"))
        return plain.join(more, by) if by else plain.join(F.broadcast(more), how="cross")

    def last(self, spark: SparkSession) -> DataFrame:
        """Each series' last estimate."""
        return metrics.last_step(self.history(spark), ["x_upd", "p_upd"])

    def window(self, spark: SparkSession, low: int | None = None, high: int | None = None) -> DataFrame:
        """Steps low <= k < high; all where there are none."""
        return metrics.window_of(self.history(spark), low, high)

    def plot_rows(self, spark: SparkSession, sigmas: float = 2.0) -> DataFrame:
        """(series, k, component, truth, value, lo, hi): what a plot of the history shows, of every component."""
        out = None
        for i in range(self.model.dim_x):
            own = metrics.envelope(self.history(spark), F.col("x_upd")[i], F.col("p_upd")[i][i], ["series"], sigmas)
            own = own.select("series", "k", F.lit(i).cast("long").alias("component"), F.col("x_true")[i].alias("truth"), "value", "lo", "hi")
            out = own if out is None else out.unionByName(own)
        return out

    def summary(self) -> str:
        kind = f"{self.steps} steps of {self.series} simulated series" if self.steps is not None else "given rows"
        return f"{self.method} over {kind}\n{self.model.summary()}"
