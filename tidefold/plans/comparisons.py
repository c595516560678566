"""Queries that score filters and baselines over bars of the events: experiments on real rows, pairs of columns, offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import diagnostics, learned, metrics, prepare, sigma, simulate
from tidefold.operators.filters import filter_each, filter_series, observations
from tidefold.plans import models
from tidefold.plans import sql_text as st
from tidefold.plans.catalogue import _SV, QUERIES, add, lines, r, rs, table  # noqa: F401
from tidefold.plans.models import Model
from tidefold.sources import files
from tidefold.sources.scratch import scratch

# --- hourly bars: states and observations of table rows ---------------------------------------------------------------

#: Log variance and log squared return of each hour with a range: x is the truth, y what is observed.
HOURS = _SV.replace("CAST(ts AS DATE) AS day", "date_trunc('hour', ts) AS day")
assert HOURS != _SV
#: Two states (log range, log body) and two observations (log of high to open and of low to open) of every hour.
BODIES = "hb AS (SELECT event_type AS series, date_trunc('hour', ts) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL), two AS (SELECT series, day, ln(high / low) AS a, ln(close / open) AS b, ln(high / open) AS c, ln(low / open) AS d FROM hb WHERE low > 0)"
_PLACE = "row_number() OVER (PARTITION BY series ORDER BY day) - 1"
OBS_1 = f"SELECT series, day, {_PLACE} AS k, y AS y_0, x AS t_0, y AS t_1 FROM sv"
OBS_2 = f"SELECT series, day, {_PLACE} AS k, c AS y_0, d AS y_1, a AS t_0, b AS t_1 FROM two"


def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.time_bars(table(spark, sf, "events"), F.col("event_type"), "hour", "ts", "event_id", F.col("value"))


def hours(spark: SparkSession, sf: str) -> DataFrame:
    """(series, day, x, y) of each hour."""
    return prepare.stochastic_volatility(hourly_bars(spark, sf))


def hour_rows(spark: SparkSession, sf: str, with_y: bool = False) -> DataFrame:
    """What filters read; with_y: the truth of an augmented state, (x, y)."""
    return observations(hours(spark, sf), "series", ["day"], ["y"], ["x", "y"] if with_y else ["x"])


def body_rows(spark: SparkSession, sf: str, copied: bool = False) -> DataFrame:
    """Two states and two observations; copied: the truth of an augmented state."""
    b = hourly_bars(spark, sf).where("low > 0")
    part = lambda p, q: F.log(F.col(p) / F.col(q))
    x, y = [part("high", "low"), part("close", "open")], [part("high", "open"), part("low", "open")]
    return observations(b, "series", ["day"], y, x + y if copied else x)


def steps_sql(ctes: str, obs: str, model: Model, method: str = "epkf", sigma_set: str = "wan2000", dim: int = 1) -> str:
    """CTEs of the rows and of a filter over them, and e: steps with their truth t_0.. ."""
    return f"WITH RECURSIVE {ctes}, {st.filter_sql(model, obs, method, sigma_set).removeprefix('WITH RECURSIVE ')}, e AS (SELECT f.*, {', '.join(f'o.t_{i}' for i in range(dim))} FROM f JOIN o ON o.series = f.series AND o.k = f.k)"


HOUR_MODEL = models.pairwise_param(b=0.3, q_x=0.5, q_y=4.0)
BODY_MODEL = models.create("model_x2_y2_AQ_pairwise")
WIDE_MODEL = models.create("model_x1_y1_augmented")
_E = steps_sql(HOURS, OBS_1, HOUR_MODEL)
_E2 = steps_sql(BODIES, OBS_2, BODY_MODEL, "pkf", dim=2)
_EW = steps_sql(HOURS, OBS_1, WIDE_MODEL, dim=2)
_ERR, _ERR1 = "(t_0 - x_0)", "(t_1 - x_1)"
_OUT = ("x_pred", "innov", "s", "x_upd", "p_upd")


def hour_steps(spark: SparkSession, sf: str, method: str = "epkf", **options) -> DataFrame:
    return filter_series(hour_rows(spark, sf), HOUR_MODEL, method, output=_OUT, **options)


def body_steps(spark: SparkSession, sf: str) -> DataFrame:
    return filter_series(body_rows(spark, sf), BODY_MODEL, "pkf", output=_OUT)


def wide_steps(spark: SparkSession, sf: str) -> DataFrame:
    return filter_series(hour_rows(spark, sf, True), WIDE_MODEL, "epkf", output=_OUT)


def rounded(df: DataFrame, *kept: str) -> DataFrame:
    """df with six decimals where a column is a double; kept ones first."""
    return df.select(*kept, *[r(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c not in kept])


def all_of(*columns: str) -> str:
    return ", ".join(f"{rs(c)} AS {n}" for c, n in (c.rsplit(" AS ", 1) for c in columns))


# --- scores -----------------------------------------------------------------------------------------------------------

add("bar_scores", lambda s, d: rounded(metrics.errors(hour_steps(s, d), ["series"]), "series"), f"{_E} SELECT series, {all_of(f'avg({_ERR} * {_ERR}) AS mse', f'avg(abs({_ERR})) AS mae', f'sqrt(avg({_ERR} * {_ERR})) AS rmse')}, count(*) AS n FROM e GROUP BY series")
add("bar_nees_nis", lambda s, d: rounded(metrics.with_nis(metrics.with_nees(hour_steps(s, d), 1), 1).select("series", "k", "nees", "nis")), f"{_E} SELECT series, k, {all_of(f'{_ERR} * {_ERR} / p_0_0 AS nees', 'i_0 * i_0 / s_0_0 AS nis')} FROM e")
_DET = "(p_0_0 * p_1_1 - p_0_1 * p_1_0)"
_FORM = f"({_ERR} * {_ERR} * p_1_1 - {_ERR} * {_ERR1} * (p_0_1 + p_1_0) + {_ERR1} * {_ERR1} * p_0_0) / {_DET}"
add("bar_nees_2d", lambda s, d: rounded(metrics.with_nees(body_steps(s, d), 2).groupBy("series").agg(F.avg("nees").alias("nees"))), f"{_E2} SELECT series, {rs(f'avg({_FORM})')} AS nees FROM e GROUP BY series")
# Four components go through NumPy; a test holds them against NumPy row by row.
add("bar_nees_4d", lambda s, d: rounded(metrics.with_nees(filter_series(body_rows(s, d, True), models.create("model_x2_y2_AQ_augmented"), "pkf", output=("x_upd", "p_upd")), 4).select("series", "k", "nees")))
add("bar_consistency", lambda s, d: rounded(metrics.consistency(hour_steps(s, d), 1, 1, ["series"])), f"{_E} SELECT series, {all_of(f'avg({_ERR} * {_ERR} / p_0_0) AS nees', 'avg(i_0 * i_0 / s_0_0) AS nis')}, avg({_ERR} * {_ERR} / p_0_0) BETWEEN 0.5 AND 2.0 AS calibrated FROM e GROUP BY series")
add("bar_whiteness", lambda s, d: rounded(metrics.whiteness(body_steps(s, d), ["series"])), f"{_E2} " + " UNION ALL ".join(f"SELECT series, CAST({i} AS BIGINT) AS component, {all_of(f'avg(i_{i}) AS innov_mean', f'stddev_pop(i_{i}) AS innov_std')} FROM e GROUP BY series" for i in (0, 1)))
add("bar_component_mse", lambda s, d: rounded(metrics.errors(body_steps(s, d), ["series", "component"]).select("series", "component", "mse", "mae")), f"{_E2} " + " UNION ALL ".join(f"SELECT series, CAST({i} AS BIGINT) AS component, {all_of(f'avg((t_{i} - x_{i}) * (t_{i} - x_{i})) AS mse', f'avg(abs(t_{i} - x_{i})) AS mae')} FROM e GROUP BY series" for i in (0, 1)))
add("bar_block_metrics", lambda s, d: rounded(metrics.block_errors(wide_steps(s, d), 1)), f"{_EW} SELECT {all_of(f'avg({_ERR} * {_ERR}) AS mse_x', f'avg({_ERR1} * {_ERR1}) AS mse_y', f'avg(abs({_ERR})) AS mae_x', f'avg(abs({_ERR1})) AS mae_y')} FROM e")
add("bar_state_part", lambda s, d: rounded(metrics.errors(metrics.state_part(wide_steps(s, d), 1), ["series"]).select("series", "mse", "n")), f"{_EW} SELECT series, {rs(f'avg({_ERR} * {_ERR})')} AS mse, count(*) AS n FROM e GROUP BY series")
add("bar_rolling_nees", lambda s, d: rounded(metrics.rolling_mean(metrics.with_nees(hour_steps(s, d), 1), "nees", 30, ["series"]).select("series", "k", "nees_mean")), f"{_E}, w AS (SELECT series, k, avg({_ERR} * {_ERR} / p_0_0) OVER v AS m, count(*) OVER v AS n FROM e WINDOW v AS (PARTITION BY series ORDER BY k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT series, k, {rs('m')} AS nees_mean FROM w WHERE n = 30")
add("bar_envelope", lambda s, d: rounded(metrics.envelope(hour_steps(s, d), F.col("x_upd")[0], F.col("p_upd")[0][0], ["series"]).select("series", "k", "value", "lo", "hi")), f"{_E} SELECT series, k, {all_of('x_0 AS value', 'x_0 - 2 * sqrt(p_0_0) AS lo', 'x_0 + 2 * sqrt(p_0_0) AS hi')} FROM e")


def plot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a plot of a history shows: every component's truth, estimate and envelope, a row each."""
    one = [metrics.envelope(body_steps(spark, sf), F.col("x_upd")[i], F.col("p_upd")[i][i], ["series"]).select("series", "k", F.lit(i).cast("long").alias("component"), F.col("x_true")[i].alias("truth"), "value", "lo", "hi") for i in (0, 1)]
    return rounded(one[0].unionByName(one[1]))


add("bar_plot_rows", plot_rows, f"{_E2} " + " UNION ALL ".join(f"SELECT series, k, CAST({i} AS BIGINT) AS component, {all_of(f't_{i} AS truth', f'x_{i} AS value', f'x_{i} - 2 * sqrt(greatest(p_{i}_{i}, 0)) AS lo', f'x_{i} + 2 * sqrt(greatest(p_{i}_{i}, 0)) AS hi')} FROM e" for i in (0, 1)))
_Q = (0.25, 0.5, 0.75)
add("bar_nees_quartiles", lambda s, d: rounded(metrics.with_nees(hour_steps(s, d), 1).groupBy("series").agg(*[F.percentile("nees", F.lit(q)).alias(f"q{int(100 * q)}") for q in _Q])), f"{_E} SELECT series, {all_of(*[f'quantile_cont({_ERR} * {_ERR} / p_0_0, {q}) AS q{int(100 * q)}' for q in _Q])} FROM e GROUP BY series")
add("bar_last_step", lambda s, d: metrics.last_step(hour_steps(s, d), ["x_upd"]).select("series", "k", r(F.col("x_upd")[0]).alias("x_0")), f"{_E} SELECT series, k, {rs('x_0')} AS x_0 FROM e QUALIFY k = max(k) OVER (PARTITION BY series)")


def _beside(first: str, model: Model, obs: str, method: str, name: str, sigma_set: str = "wan2000") -> str:
    """One more filter's CTEs after those of first: steps in f_<name>."""
    more = st.filter_sql(model, obs, method, sigma_set).removeprefix("WITH RECURSIVE ")
    for a, b in ((" f AS ", f" f_{name} AS "), ("FROM f JOIN o ON", f"FROM f_{name} AS f JOIN o_{name} AS o ON"), ("FROM o WHERE", f"FROM o_{name} WHERE")):
        more = more.replace(a, b)
    return f"{first}, o_{name} AS {more.removeprefix('o AS ')}"


add("bar_tail_difference", lambda s, d: rounded(metrics.tail_difference(*[hour_steps(s, d, m) for m in ("epkf", "upkf")])), f"{_beside(_E, HOUR_MODEL, OBS_1, 'upkf', 'u')} SELECT series, {rs('avg(abs(a - b))')} AS difference FROM (SELECT e.series, e.x_0 AS a, u.x_0 AS b, e.k, max(e.k) OVER (PARTITION BY e.series) AS last FROM e JOIN f_u u ON u.series = e.series AND u.k = e.k) WHERE k > last - 50 GROUP BY series")
add("bar_zero_baseline", lambda s, d: rounded(prepare.naive_zero(hours(s, d), ["series"])), f"WITH {HOURS} SELECT series, {rs('avg(x * x)')} AS mse FROM sv GROUP BY series")
add("bar_wide", lambda s, d: rounded(simulate.wide(prepare.ordinal(body_rows(s, d), "series", ["ord_0"]).select("series", "k", F.col("x_true").alias("x"), "y"), 2, 2)), f"WITH {BODIES} SELECT series, {_PLACE} AS k, {all_of('a AS X0', 'b AS X1', 'c AS Y0', 'd AS Y1')} FROM two")

# --- sweeps on table rows ---------------------------------------------------------------------------------------------

B_VALUES = (0.1, 0.3, 0.6)


def believed(b: float) -> Model:
    return models.pairwise_param(b=b, q_x=0.5, q_y=4.0)


def bar_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(value, method, series, mse): every value's filters on every series, each row read once for all."""
    entrants = {b: [(m, believed(b), m, {}) for m in ("epkf", "upkf")] for b in B_VALUES}
    rows = hour_rows(spark, sf).withColumn("value", F.explode(F.array(*[F.lit(b) for b in B_VALUES])))
    e = F.col("x_true")[0] - F.col("x_upd")[0]
    return filter_each(rows, entrants, output=("x_upd",)).groupBy("value", "method", "series").agg(F.avg(e * e).alias("mse"))


def bar_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread over series of each value's and method's error, and its gap to the extended filter's, relative to that one's spread."""
    rows = metrics.over_seeds(bar_runs(spark, sf), ["mse"], ["value", "method"], counted=True)
    first = rows.where("method = 'epkf'").select("value", F.col("mse_mean").alias("_mean"), F.col("mse_std").alias("_std"))
    return rounded(rows.join(first, "value").withColumn("gap", F.abs(F.col("mse_mean") - F.col("_mean")) / F.col("_std")).drop("_mean", "_std"))


def _bar_sweep_sql() -> str:
    parts = [f"SELECT {st.num(b)} AS value, '{m}' AS method, series, mse FROM ({steps_sql(HOURS, OBS_1, believed(b), m)} SELECT series, avg({_ERR} * {_ERR}) AS mse FROM e GROUP BY series)" for b in B_VALUES for m in ("epkf", "upkf")]
    means = f"m AS (SELECT value, method, count(*) AS n, avg(mse) AS a, stddev_pop(mse) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY value, method)"
    return f"WITH {means} SELECT m.value, m.method, m.n, {all_of('m.a AS mse_mean', 'm.s AS mse_std', 'abs(m.a - b.a) / b.s AS gap')} FROM m JOIN m b ON b.value = m.value AND b.method = 'epkf'"


add("bar_sweep", bar_sweep, _bar_sweep_sql())


def bar_sigma_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """MSE by series and sigma set, sets as columns: all sets read each row once."""
    entrants = {0.0: [(key, HOUR_MODEL, "upkf", {"sigma_set": key}) for key in sigma.names()]}
    steps = filter_each(hour_rows(spark, sf).withColumn("value", F.lit(0.0)), entrants, output=("x_upd",))
    e = F.col("x_true")[0] - F.col("x_upd")[0]
    return rounded(steps.groupBy("series").pivot("method", sigma.names()).agg(F.avg(e * e)), "series")


_SETS = [f"{key} AS (SELECT series, {rs('mse')} AS {key} FROM ({steps_sql(HOURS, OBS_1, HOUR_MODEL, 'upkf', key)} SELECT series, avg({_ERR} * {_ERR}) AS mse FROM e GROUP BY series))" for key in sigma.names()]
add("bar_sigma_matrix", bar_sigma_matrix, f"WITH {', '.join(_SETS)} SELECT series, {', '.join(sigma.names())} FROM {sigma.names()[0]}" + "".join(f" JOIN {k} USING (series)" for k in sigma.names()[1:]))


def augmented_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Extended and unscented filters of the augmented model, scored on the state's own part. No SQL: the unscented one takes roots of 2x2 matrices."""
    rows = hour_rows(spark, sf, True).withColumn("value", F.lit(0.0))
    steps = filter_each(rows, {0.0: [(m, WIDE_MODEL, m, {}) for m in ("epkf", "ukf")]}, output=("x_upd", "p_upd"))
    scored = metrics.with_nees(metrics.state_part(steps, 1), 1).withColumn("_e", F.col("x_true")[0] - F.col("x_upd")[0])
    return rounded(scored.groupBy("method").agg(F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.avg(F.abs("_e")).alias("mae"), F.avg("nees").alias("nees"), F.count("*").alias("n")), "method")


add("augmented_filters", augmented_filters)

# --- pairs of columns, offenders --------------------------------------------------------------------------------------


def error_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The filter's estimate with NEES and NIS, the observation as an estimate, and both components of an augmented truth with themselves halved."""
    steps = hour_steps(spark, sf).withColumn("_half", F.array(F.col("x_true")[0] / 2, F.col("y")[0] / 2)).withColumn("_both", F.concat("x_true", "y"))
    pairs = [metrics.Pair("estimate", "x_true", "x_upd", "p_upd", "innov", "s"), metrics.Pair("observation", "x_true", "y"), metrics.Pair("half", "_both", "_half")]
    # -1: all components.
    return rounded(metrics.compare(steps, pairs).withColumn("component", F.coalesce("component", F.lit(-1).cast("long"))))


def _pairs_sql() -> str:
    rows = f"SELECT 'estimate' AS pair, series, CAST(0 AS BIGINT) AS component, {_ERR} AS error, {_ERR} * {_ERR} / p_0_0 AS nees, i_0 * i_0 / s_0_0 AS nis FROM e"
    rows += f" UNION ALL SELECT 'observation', series, CAST(0 AS BIGINT), t_0 - t_1, NULL, NULL FROM e UNION ALL SELECT 'half', series, CAST(0 AS BIGINT), t_0 / 2, NULL, NULL FROM e UNION ALL SELECT 'half', series, CAST(1 AS BIGINT), t_1 / 2, NULL, NULL FROM e"
    whole = "CASE WHEN grouping(component) = 1 THEN"
    both = steps_sql(HOURS, OBS_1, HOUR_MODEL, dim=2)
    return f"{both}, l AS ({rows}) SELECT pair, series, coalesce(component, -1) AS component, {all_of('avg(error * error) AS mse', 'avg(abs(error)) AS mae', 'sqrt(avg(error * error)) AS rmse', f'{whole} avg(nees) END AS nees', f'{whole} avg(nis) END AS nis')}, count(*) AS n FROM l GROUP BY GROUPING SETS ((pair), (pair, series), (pair, component), (pair, series, component))"


add("error_pairs", error_pairs, _pairs_sql())


def offenders(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' lines whose margin, taken as a variance, is strongly negative: the first five orders of each."""
    v = F.col("l_discount") - 0.02 - F.col("l_tax") * F.col("l_quantity") / 100
    return rounded(metrics.first_offenders(lines(spark, sf), v, ["l_suppkey"], "l_orderkey"))


add(
    "first_offenders",
    offenders,
    f"WITH v AS (SELECT l_suppkey, l_orderkey, l_discount - {st.num(0.02)} - l_tax * l_quantity / 100 AS v FROM lineitem), s AS (SELECT l_suppkey, greatest(1e-12, 1e-6 * max(abs(v))) AS slack FROM v GROUP BY l_suppkey), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, v) AS i FROM v JOIN s USING (l_suppkey) WHERE v < -slack) SELECT l_suppkey, list(l_orderkey ORDER BY i) FILTER (i <= 5) AS places, count(*) AS n_bad, {all_of('max(abs(v)) AS worst', 'max(slack) AS slack')} FROM b GROUP BY l_suppkey",
)

# --- several filters and baselines on one series ----------------------------------------------------------------------


def middle(spark: SparkSession, sf: str) -> str:
    """The day in the middle of the events: rows before it teach, later ones test."""
    day = F.to_date("ts")
    return str(table(spark, sf, "events").agg(F.date_add(F.min(day), F.floor(F.date_diff(F.max(day), F.min(day)) / 2).cast("int"))).first()[0])


_HALF = "(SELECT CAST(min(ts) AS DATE) + CAST(floor(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 2) AS INTEGER) FROM events)"


def contest(train: DataFrame, test: DataFrame, entrants: list[tuple[str, Model, str, dict]]) -> DataFrame:
    """(method, mse, mae, nees, nis, n) of filters and of three baselines on (series, day, x, y): all filters read each row once, and one aggregate scores all.

    The baselines are the observation, the one before, and the mean of x in train. nees and nis are null where a method
    has none: baselines, and nis of particle filters.
    """
    rows = observations(test, "series", ["day"], ["y"], ["x"]).withColumn("value", F.lit(0.0))
    steps = metrics.with_nis(metrics.with_nees(filter_each(rows, {0.0: entrants}, output=("innov", "s", "x_upd", "p_upd")), 1), 1)
    clouds = [name for name, _, method, _ in entrants if method in ("pf", "ppf")]
    nis = F.when(~F.col("method").isin(clouds), F.col("nis")) if clouds else F.col("nis")
    filtered = steps.select("method", (F.col("x_true")[0] - F.col("x_upd")[0]).alias("error"), "nees", nis.alias("nis"))
    mean = train.agg(F.avg("x")).first()[0]
    based = prepare.baselines(test, "series", "day").withColumn("training_mean", F.lit(mean).cast("double"))
    none = F.lit(None).cast("double")
    plain = based.select("x", F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("e")) for c in ("single_shot", "persistence", "training_mean")])).alias("_b"))
    plain = plain.select("_b.method", (F.col("x") - F.col("_b.e")).alias("error"), none.alias("nees"), none.alias("nis"))
    e = F.col("error")
    return filtered.unionByName(plain).groupBy("method").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg("nees").alias("nees"), F.avg("nis").alias("nis"), F.count("*").alias("n"))


def sv_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two filters of a model given beforehand, and the baselines, on the second half of the hours."""
    train, test = prepare.split_by_day(hours(spark, sf), middle(spark, sf))
    return rounded(contest(train, test, [(m, HOUR_MODEL, m, {}) for m in ("epkf", "upkf")]), "method")


def _contest_sql(ctes: str, model: Model, train: str, test: str) -> str:
    obs = f"SELECT series, {_PLACE} AS k, y AS y_0, x AS t_0 FROM sv WHERE {test}"
    both = _beside(steps_sql(ctes, obs, model), model, obs, "upkf", "u")
    rows = f"SELECT 'epkf' AS method, {_ERR} AS error, {_ERR} * {_ERR} / p_0_0 AS nees, i_0 * i_0 / s_0_0 AS nis FROM e"
    rows += " UNION ALL SELECT 'upkf', o.t_0 - u.x_0, (o.t_0 - u.x_0) * (o.t_0 - u.x_0) / u.p_0_0, u.i_0 * u.i_0 / u.s_0_0 FROM f_u u JOIN o ON o.series = u.series AND o.k = u.k"
    rows += " UNION ALL SELECT 'single_shot', t_0 - y_0, NULL, NULL FROM o UNION ALL SELECT 'persistence', t_0 - coalesce(lag(y_0) OVER (PARTITION BY series ORDER BY k), y_0), NULL, NULL FROM o"
    rows += f" UNION ALL SELECT 'training_mean', t_0 - (SELECT avg(x) FROM sv WHERE {train}), NULL, NULL FROM o"
    return f"{both}, l AS ({rows}) SELECT method, {all_of('avg(error * error) AS mse', 'avg(abs(error)) AS mae', 'avg(nees) AS nees', 'avg(nis) AS nis')}, count(*) AS n FROM l GROUP BY method"


add("sv_comparison", sv_comparison, _contest_sql(HOURS, HOUR_MODEL, f"day <= {_HALF}", f"day > {_HALF}"))

# Particles, and the spread of the prior around the first test row.
N_PARTICLES, FIRST_SPREAD = 1000, 5.0
#: Training of the queries: a step is a job, so larger steps are taken fewer times than by default.
TRAINING = {"epochs": 60, "rate": 0.01}


def first_row(test: DataFrame) -> list[float]:
    """The mean over series of the first row's (x, y)."""
    rows = test.groupBy("series").agg(F.min_by(F.struct("x", "y"), "day").alias("f")).agg(F.avg("f.x"), F.avg("f.y")).first()
    return [float(v) for v in rows]


def taught(train: DataFrame, test: DataFrame, **options) -> learned.LearnedModel:
    """A model of (x, y) learned from train, its prior around the first test row."""
    pairs = prepare.consecutive_pairs(train, "series", "day", ["x", "y"])
    return learned.learn(pairs, ["x", "y"], start=first_row(test), spread=FIRST_SPREAD, **(TRAINING | options))


def sv_comparison_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Three filters of a learned model and three baselines on the second half of the hours. No SQL: the model is trained."""
    train, test = prepare.split_by_day(hours(spark, sf), middle(spark, sf))
    model = taught(train, test)
    entrants = [("epkf", model, "epkf", {}), ("upkf", model, "upkf", {}), ("ppf", model, "ppf", {"n_particles": N_PARTICLES, "seed": 42})]
    return rounded(contest(train, test, entrants), "method")


def epkf_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of the learned model's extended filter on the second half of the hours."""
    train, test = prepare.split_by_day(hours(spark, sf), middle(spark, sf))
    steps = filter_series(observations(test, "series", ["day"], ["y"], ["x"]), taught(train, test), "epkf", output=("x_upd", "p_upd"))
    part: Column = F.col("x_upd")[0]
    return rounded(steps.select("series", "k", F.col("x_true")[0].alias("x"), part.alias("x_0"), F.col("p_upd")[0][0].alias("p_0_0")))


add("sv_comparison_learned", sv_comparison_learned)
add("epkf_learned", epkf_learned)

# --- an experiment on index files, from text to scores ----------------------------------------------------------------

#: Last year of training, and the model of both standardised series.
LAST_TRAIN = 1995
INDEX_MODEL = models.pairwise_param(b=0.3, q_x=0.5, q_y=1.0)
#: Missing months in the two formats.
NO_INDEX, NO_MONTH = -99.9, -999.9


def index_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Paths of two files made from the tables: mean order prices of each month as lines of nine fields, and mean discounts as years of twelve numbers in the first of two sections."""
    a = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 1e5).alias("v"))
    value = F.format_string("%.9f", F.when(F.col("m") == 2, NO_INDEX).otherwise(F.col("v")))
    one = a.select(F.concat_ws(" ", F.col("y").cast("string"), F.col("m").cast("string"), *[F.lit("0.0")] * 6, value).alias("value"))
    b = lines(spark, sf).groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg((-F.avg("l_discount")).alias("v"))
    # As many lines as years: months up to the last one with rows, all that are missing flagged, numbers touching at signs.
    b = b.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("m", F.format_string("%.9f", "v")))).alias("of"), F.max("m").alias("last"))
    b = b.select("y", F.concat(F.col("y").cast("string"), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), "last"), lambda i: F.coalesce(F.col("of")[i], F.lit(str(NO_MONTH)))), "")).alias("value"))
    head = spark.createDataFrame([(-2, "an index"), (-1, "YEAR   JAN   FEB"), (9998, "YEAR   again"), (9999, "1996 1.0 2.0 3.0")], "y int, value string")
    paths = scratch(spark, "index"), scratch(spark, "months")
    one.write.text(paths[0])
    head.unionByName(b).coalesce(1).sortWithinPartitions("y").select("value").write.text(paths[1])
    return paths


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(year, month, x, y) of months that both files have."""
    first, second = index_files(spark, sf)
    return prepare.monthly_join(files.read_index(spark, first), files.read_monthly_block(spark, f"{second}/part-*"))


def index_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """From files to scores: parse, join, split by year, standardise by the training years, filters and baselines."""
    rows = index_rows(spark, sf)
    train = prepare.split_by_year(rows, LAST_TRAIN)[0]
    scaled = prepare.scaled_like(train, rows, ["x", "y"]).select(F.lit(0).cast("long").alias("series"), "year", F.make_date("year", "month", F.lit(1)).alias("day"), "x", "y")
    return rounded(contest(*prepare.split_by_year(scaled, LAST_TRAIN), [(m, INDEX_MODEL, m, {}) for m in ("epkf", "upkf")]), "method")


_MONTHS = f"""a AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, round(avg(o_totalprice) / 1e5, 9) AS x FROM orders GROUP BY ALL), b AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, round(-avg(l_discount), 9) AS y FROM lineitem GROUP BY ALL), months AS (SELECT year, month, x, y FROM a JOIN b USING (year, month) WHERE month <> 2)"""
_INDEX = f"{_MONTHS}, tr AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM months WHERE year <= {LAST_TRAIN}), sv AS (SELECT 0 AS series, make_date(year, month, 1) AS day, year, (x - mx) / (sx + 1e-8) AS x, (y - my) / (sy + 1e-8) AS y FROM months, tr)"
add("index_rows", lambda s, d: rounded(index_rows(s, d)), f"WITH {_MONTHS} SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, {all_of('x AS x', 'y AS y')} FROM months")
add("index_pipeline", index_pipeline, _contest_sql(_INDEX, INDEX_MODEL, f"year <= {LAST_TRAIN}", f"year > {LAST_TRAIN}"))

# --- matrices of any size ---------------------------------------------------------------------------------------------

_NINE = ("l_quantity / 50", "l_discount * 4", "l_tax * 5")


def three_by_three(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's second moments of three scaled columns, without its diagonal's last element where its key is even."""
    cells = [[F.avg(F.expr(a) * F.expr(b)) for b in _NINE] for a in _NINE]
    rows = lines(spark, sf).groupBy("l_suppkey").agg(*[cells[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])
    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}") * (1.5 if i < j else 1.0)
    last = F.when(F.col("l_suppkey") % 2 == 0, 0.0).otherwise(F.col("c22"))
    return rows.select("l_suppkey", F.array(*[F.array(*[last if (i, j) == (2, 2) else c(i, j) for j in range(3)]) for i in range(3)]).alias("m"))


# Eigenvalues of 3x3 matrices: roots of the cubic, by its trigonometric form, or where two are complex by its real one.
_M3 = "m AS (SELECT l_suppkey, " + ", ".join(f"avg({a} * {b}) AS c{i}{j}" for i, a in enumerate(_NINE) for j, b in enumerate(_NINE) if i <= j) + " FROM lineitem GROUP BY l_suppkey), z AS (SELECT l_suppkey, c00, 1.5e0 * c01 AS u, c01 AS v, 1.5e0 * c02 AS w, c02 AS x, c11, 1.5e0 * c12 AS y, c12 AS t, CASE WHEN l_suppkey % 2 = 0 THEN 0.0e0 ELSE c22 END AS d FROM m)"
_CUBIC = f"{_M3}, k AS (SELECT *, c00 + c11 + d AS a, c00 * c11 - u * v + c00 * d - w * x + c11 * d - y * t AS b, c00 * (c11 * d - y * t) - u * (v * d - y * x) + w * (v * t - c11 * x) AS det FROM z), p AS (SELECT *, a * a / 9 - b / 3 AS q, a * a * a / 27 - a * b / 6 + det / 2 AS r FROM k), g AS (SELECT *, acos(greatest(-1, least(1, r / (q * sqrt(q))))) / 3 AS th FROM p), e AS (SELECT *, a / 3 + 2 * sqrt(q) * cos(th) AS e0, a / 3 + 2 * sqrt(q) * cos(th + 2 * pi() / 3) AS e1, a / 3 + 2 * sqrt(q) * cos(th - 2 * pi() / 3) AS e2, r * r > q * q * q AS odd, sign(r) * cbrt(abs(r) + sqrt(greatest(r * r - q * q * q, 0))) AS root FROM g), f AS (SELECT l_suppkey, odd, CASE WHEN odd THEN abs(a / 3 + root + q / root) ELSE abs(e0) END AS m0, CASE WHEN odd THEN sqrt(pow(a / 3 - (root + q / root) / 2, 2) + 0.75e0 * pow(root - q / root, 2)) ELSE abs(e1) END AS m1, CASE WHEN NOT odd THEN abs(e2) END AS m2 FROM e)"
add("stability_any", lambda s, d: rounded(diagnostics.stability(three_by_three(s, d), "m").select("l_suppkey", "radius", "n_complex", "status")), f"WITH {_CUBIC}, h AS (SELECT *, greatest(m0, m1, coalesce(m2, 0)) AS radius, least(m0, m1, coalesce(m2, m1)) AS small FROM f) SELECT l_suppkey, {rs('radius')} AS radius, CAST(CASE WHEN odd THEN 2 ELSE 0 END AS BIGINT) AS n_complex, CASE WHEN radius > 1 + 1e-10 THEN 'FAIL' WHEN radius >= 0.99 OR small < 1e-8 OR odd THEN 'WARNING' ELSE 'OK' END AS status FROM h")
# The symmetric part's eigenvalues, all real.
_SYM = "m AS (SELECT l_suppkey, " + ", ".join(f"avg({a} * {b}) AS c{i}{j}" for i, a in enumerate(_NINE) for j, b in enumerate(_NINE) if i <= j) + " FROM lineitem GROUP BY l_suppkey), z AS (SELECT l_suppkey, c00, 1.25e0 * c01 AS u, 1.25e0 * c02 AS w, c11, 1.25e0 * c12 AS y, CASE WHEN l_suppkey % 2 = 0 THEN 0.0e0 ELSE c22 END AS d FROM m), p AS (SELECT *, (c00 + c11 + d) / 3 AS q FROM z), s AS (SELECT *, sqrt(((c00 - q) * (c00 - q) + (c11 - q) * (c11 - q) + (d - q) * (d - q) + 2 * (u * u + w * w + y * y)) / 6) AS p FROM p), g AS (SELECT *, acos(greatest(-1, least(1, ((c00 - q) * ((c11 - q) * (d - q) - y * y) - u * (u * (d - q) - y * w) + w * (u * y - (c11 - q) * w)) / (2 * p * p * p)))) / 3 AS th FROM s), e AS (SELECT *, q + 2 * p * cos(th) AS high, q + 2 * p * cos(th + 2 * pi() / 3) AS low FROM g)"
add("positive_any", lambda s, d: rounded(diagnostics.positive(three_by_three(s, d), "m").select("l_suppkey", "lowest", "positive")), f"WITH {_SYM} SELECT l_suppkey, {rs('low')} AS lowest, low > 0 AS positive FROM e")
add("regularise_any", lambda s, d: rounded(diagnostics.regularise_any(three_by_three(s, d), "m").select("l_suppkey", "epsilon", "lowest_before", "lowest_after", "repair")), f"WITH {_SYM}, h AS (SELECT *, CASE WHEN low <= 1e-10 THEN 10 * greatest(abs(low) + 1e-9, CASE WHEN low <= 0 OR high >= 1e12 * low THEN high / 1e12 - low ELSE 0 END) ELSE 0 END AS eps FROM e) SELECT l_suppkey, {all_of('eps AS epsilon', 'low AS lowest_before', 'low + eps AS lowest_after')}, CASE WHEN eps = 0 THEN 'untouched' ELSE 'repaired' END AS repair FROM h")
