"""Linear, elastic net, Gaussian process, tree and support vector models on daily order counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import models
from tempora.operators.models.trees import feature_importances
from tempora.session import materialize

from .base import DAILY_DENSE, daily_targets, day_vectors_of, month, query, weekday


def _targets(spark, sf_dir):
    y = materialize(daily_targets(spark, sf_dir), "y")
    return y, materialize(y.select("day").distinct(), "days")


def _trend():
    return F.date_diff("day", F.lit("1995-01-01").cast("date")) / 1000


def _flags(expr, values):
    return [(expr == v).cast("double") for v in values]


def _calendar(days):
    """Weekday and month without their last category, and a trend."""
    return materialize(day_vectors_of(days, *_flags(weekday(), range(6)), *_flags(month(), range(1, 12)), _trend()), "x")


_X = DAILY_DENSE + ", t AS (SELECT series_id, day, value AS y, (day - DATE '1995-01-01') / 1000.0::DOUBLE AS x, isodow(day) AS wd, month(day) AS mon FROM ddense)"


@query("q43_lr_one_feature", f"""WITH {_X} SELECT series_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept
FROM t GROUP BY 1""")
def lr_one_feature_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    fitted = models.fit("lr", day_vectors_of(days, _trend()), y)
    coef = F.col("coef")
    return fitted.tables["model"].select("series_id", F.round(coef[1], 6).alias("slope"), F.round(coef[0], 6).alias("intercept"))


@query("q44_lr_onehot_group_mean", f"""WITH {_X} SELECT series_id, day, round(avg(y) OVER (PARTITION BY series_id, wd), 6) AS pred FROM t""")
def lr_group_mean_query(spark, sf_dir):
    """Least squares on the weekday indicators predicts the weekday means."""
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, *_flags(weekday(), range(6)))
    pred = models.predict(models.fit("lr", x, y), x)
    return pred.select("series_id", "day", F.round("pred", 6).alias("pred"))


_ALPHA, _RATIO = 0.01, 0.5


@query("q45_en_one_feature", f"""WITH {_X}, s AS (SELECT series_id, covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM t GROUP BY 1),
w AS (SELECT *, sign(c) * greatest(abs(c) - {_ALPHA * _RATIO}, 0) / (v + {_ALPHA * (1 - _RATIO)}) AS w FROM s)
SELECT series_id, round(w, 6) + 0.0 AS slope, round(my - w * mx, 6) AS intercept FROM w""")
def en_one_feature_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    fitted = models.fit("en", day_vectors_of(days, _trend()), y, {"alpha": _ALPHA, "l1_ratio": _RATIO, "tol": 1e-8})
    coef = F.col("coef")
    return fitted.tables["model"].select("series_id", (F.round(coef[1], 6) + 0.0).alias("slope"),
                                         F.round(coef[0], 6).alias("intercept"))


def _gradients(fitted, x, y):
    """Per series and coefficient: mean of feature times residual, next to the coefficient."""
    pred = models.predict(fitted, x, floor=False)
    rows = pred.join(y, ["series_id", "day", "step"]).join(x, "day")
    cells = F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("idx", "v")
    grads = rows.select("series_id", (F.col("y") - F.col("pred")).alias("r"), cells).groupBy("series_id", "idx").agg(
        F.avg(F.col("v") * F.col("r")).alias("g"))
    coefs = fitted.tables["model"].select("series_id", F.posexplode("coef").alias("idx", "w"))
    return grads.join(coefs, ["series_id", "idx"])


@query("q46_lr_multi", """SELECT DISTINCT o_orderpriority AS series_id, unnest(range(19))::INT AS idx, 0.0::DOUBLE AS gradient FROM orders""")
def lr_multi_query(spark, sf_dir):
    """18 features: at the least squares solution every feature is orthogonal to the residuals."""
    y, days = _targets(spark, sf_dir)
    x = _calendar(days)
    return _gradients(models.fit("lr", x, y), x, y).select("series_id", "idx", F.abs(F.round("g", 6)).alias("gradient"))


@query("q47_en_multi", """SELECT DISTINCT o_orderpriority AS series_id, unnest(range(19))::INT AS idx, 0.0::DOUBLE AS violation FROM orders""")
def en_multi_query(spark, sf_dir):
    """18 features: the optimality conditions of the elastic net hold at the solution."""
    y, days = _targets(spark, sf_dir)
    x = _calendar(days)
    alpha, ratio = 0.005, 0.5
    fitted = models.fit("en", x, y, {"estimator__alpha": alpha, "estimator__l1_ratio": ratio, "estimator__tol": 1e-6})
    g, w = F.col("g"), F.col("w")
    inactive = F.greatest(F.abs(g) - alpha * ratio, F.lit(0.0))
    active = F.abs(g - alpha * ratio * F.signum(w) - alpha * (1 - ratio) * w)
    violation = F.when(F.col("idx") == 0, F.abs(g)).when(w == 0, inactive).otherwise(active)
    return _gradients(fitted, x, y).select("series_id", "idx", F.abs(F.round(violation, 5)).alias("violation"))


_BEATS = f"""WITH {_X}, m AS (SELECT *, avg(y) OVER (PARTITION BY series_id) AS mean FROM t)
SELECT series_id, count(*) AS n, round(avg(abs(y - mean)), 6) AS mean_mae, 1 AS beats_mean FROM m GROUP BY 1"""


def _against_mean(pred, y):
    """Per series: number of predicted cells, error of the constant mean, and whether the model's error is smaller."""
    mean = y.groupBy("series_id").agg(F.avg("y").alias("mean"))
    pairs = pred.join(y, ["series_id", "day", "step"]).join(mean, "series_id")
    out = pairs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("model_mae"),
                                         F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mean_mae"))
    beats = (F.col("model_mae") < F.col("mean_mae")).cast("int").alias("beats_mean")
    return out.select("series_id", "n", F.round("mean_mae", 6).alias("mean_mae"), beats)


@query("q48_gp", _BEATS)
def gp_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday(), month())
    return _against_mean(models.predict(models.fit("gp", x, y, {"alpha": 0.1, "normalize_y": True}), x), y)


@query("q48_gp_interpolates", f"WITH {_X} SELECT DISTINCT series_id, wd - 1 AS wd, mon, 0.0::DOUBLE AS gap FROM t")
def gp_interpolation_query(spark, sf_dir):
    """Without noise the mean meets the average target of every feature tuple."""
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday(), month())
    pred = models.predict(models.fit("gp", x, y, {"alpha": 1e-10}), x, floor=False)
    keys = ["series_id", weekday().cast("long").alias("wd"), month().cast("long").alias("mon")]
    pairs = pred.join(y, ["series_id", "day", "step"]).groupBy(*keys).agg(F.avg("y").alias("m"), F.avg("pred").alias("p"))
    return pairs.select("series_id", "wd", "mon", F.abs(F.round(F.col("p") - F.col("m"), 4)).alias("gap"))


@query("q49_rf", _BEATS)
def rf_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday(), month(), _trend())
    fitted = models.fit("rf", x, y, {"n_estimators": 20, "max_depth": 8, "random_state": 1, "max_features": "auto"})
    return _against_mean(models.predict(fitted, x), y)


@query("q49_rf_importances")
def rf_importances_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday(), month(), _trend())
    fitted = models.fit("rf", x, y, {"n_estimators": 10, "max_depth": 6, "random_state": 1})
    return feature_importances(fitted, ["weekday", "month", "trend"])


@query("q50_gbr", _BEATS)
def gbr_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday(), month(), _trend())
    fitted = models.fit("gbr", x, y, {"estimator__n_estimators": 10, "estimator__max_depth": 5, "estimator__random_state": 1})
    return _against_mean(models.predict(fitted, x), y)


@query("q51_svr", _BEATS)
def svr_query(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday() / 6, month() / 12, _trend())
    fitted = models.fit("svr", x, y, {"estimator__C": 1.0, "estimator__epsilon": 0.1, "estimator__gamma": 5.0})
    return _against_mean(models.predict(fitted, x), y)
