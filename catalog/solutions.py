"""Models held against their values: trees, boosting, Gaussian process, support vectors, search scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import models
from tempora.operators.models.trees import feature_importances
from tempora.operators.reshape import day_vectors
from tempora.operators.tune import grid_search
from tempora.session import materialize

from .base import DAILY_DENSE, HOURLY, day_vectors_of, event_counts, month, query, weekday
from .regression import _X, _flags, _targets, _trend

_NAMES = ["weekday", "month", "trend"]

# the best cut of each series: every feature, every threshold between two values
_CUT = _X + """, u AS (SELECT series_id, 0 AS f, (wd - 1)::DOUBLE AS v, y FROM t UNION ALL SELECT series_id, 1, mon, y FROM t UNION ALL SELECT series_id, 2, x, y FROM t),
g AS (SELECT series_id, f, v, count(*) AS n, sum(y) AS s FROM u GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER p AS tn, sum(s) OVER p AS ts, lead(v) OVER (PARTITION BY series_id, f ORDER BY v) AS nv
  FROM g WINDOW w AS (PARTITION BY series_id, f ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY series_id, f)),
k AS (SELECT series_id, f, (v + nv) / 2 AS thr, ls / ln AS lv, (ts - ls) / (tn - ln) AS rv, ts / tn AS mean, ln, tn - ln AS rn,
  ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM c WHERE nv IS NOT NULL AND ln >= 30 AND tn - ln >= 30),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(gain, 6) DESC, f, thr) = 1),
s AS (SELECT t.series_id, t.day, b.mean, CASE WHEN (CASE f WHEN 0 THEN wd - 1 WHEN 1 THEN mon ELSE x END) <= thr THEN lv ELSE rv END AS side FROM t JOIN b USING (series_id))"""


def _three(spark, sf_dir):
    y, days = _targets(spark, sf_dir)
    return materialize(day_vectors_of(days, weekday(), month(), _trend()), "x"), y


_STUMP = {"n_estimators": 1, "bootstrap": False, "max_depth": 1, "min_samples_leaf": 30}


@query("q49_rf_stump", f"WITH {_CUT} SELECT series_id, f AS feature, round(thr, 6) AS threshold, round(lv, 6) AS low_mean, round(rv, 6) AS high_mean, round(gain, 3) AS gain FROM b")
def rf_stump_query(spark, sf_dir):
    """A tree of one cut per series: the cut with the greatest fall in squared error."""
    x, y = _three(spark, sf_dir)
    trees = models.fit("rf", x, y, _STUMP).tables["model"]
    return trees.select("series_id", F.col("feature")[0].alias("feature"), F.round(F.col("threshold")[0], 6).alias("threshold"), F.round(F.col("value")[1], 6).alias("low_mean"),
                        F.round(F.col("value")[2], 6).alias("high_mean"), F.round(F.col("gain")[0], 3).alias("gain"))


@query("q49_rf_stump_predict", f"WITH {_CUT} SELECT series_id, day, round(side, 6) AS pred FROM s")
def rf_stump_predict_query(spark, sf_dir):
    x, y = _three(spark, sf_dir)
    return models.predict(models.fit("rf", x, y, _STUMP), x).select("series_id", "day", F.round("pred", 6).alias("pred"))


@query("q49_rf_stump_importances", f"""WITH {_CUT} SELECT series_id, n.name AS feature, CASE WHEN n.f = b.f THEN 100.0 ELSE 0.0 END AS percent
FROM b, (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_NAMES))}) n(f, name)""")
def rf_stump_importances_query(spark, sf_dir):
    x, y = _three(spark, sf_dir)
    return feature_importances(models.fit("rf", x, y, _STUMP), _NAMES).select("series_id", "feature", "percent")


_WEEKDAYS = DAILY_DENSE + ", t AS (SELECT series_id, day, value AS y, isodow(day) AS wd FROM ddense)"


@query("q49_rf_full_tree", f"WITH {_WEEKDAYS} SELECT series_id, day, round(avg(y) OVER (PARTITION BY series_id, wd), 6) AS pred FROM t")
def rf_full_tree_query(spark, sf_dir):
    """A tree without a limit on one feature ends with a leaf for each of its values."""
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, weekday())
    pred = models.predict(models.fit("rf", x, y, {"n_estimators": 1, "bootstrap": False, "max_depth": None}), x)
    return pred.select("series_id", "day", F.round("pred", 6).alias("pred"))


@query("q50_gbr_stage", f"WITH {_CUT} SELECT series_id, day, round(mean + 0.5 * (side - mean), 6) AS pred FROM s")
def gbr_stage_query(spark, sf_dir):
    """One stage of boosting: the mean, and half of what the best cut of the residuals leaves."""
    x, y = _three(spark, sf_dir)
    fitted = models.fit("gbr", x, y, {"estimator__n_estimators": 1, "estimator__learning_rate": 0.5, "estimator__max_depth": 1, "estimator__min_samples_leaf": 30})
    return models.predict(fitted, x).select("series_id", "day", F.round("pred", 6).alias("pred"))


@query("q48_gp_two_tuples", f"""WITH {_WEEKDAYS}, a AS (SELECT *, (wd > 5)::INT AS z, avg(y) OVER (PARTITION BY series_id) AS c FROM t),
m AS (SELECT series_id, any_value(c) AS c, avg(y) FILTER (z = 0) - any_value(c) AS m0, avg(y) FILTER (z = 1) - any_value(c) AS m1,
  1 + 0.1 / count(*) FILTER (z = 0) AS d0, 1 + 0.1 / count(*) FILTER (z = 1) AS d1, exp(-0.5) AS k FROM a GROUP BY 1),
w AS (SELECT *, (d1 * m0 - k * m1) / (d0 * d1 - k * k) AS a0, (d0 * m1 - k * m0) / (d0 * d1 - k * k) AS a1 FROM m)
SELECT series_id, day, round(CASE WHEN wd > 5 THEN k * a0 + a1 ELSE a0 + k * a1 END + c, 6) AS pred FROM t JOIN w USING (series_id)""")
def gp_two_tuples_query(spark, sf_dir):
    """A process with one 0/1 feature: the inverse of a 2 x 2 matrix."""
    y, days = _targets(spark, sf_dir)
    x = day_vectors_of(days, (weekday() >= 5).cast("double"))
    pred = models.predict(models.fit("gp", x, y, {"alpha": 0.1, "normalize_y": True}), x)
    return pred.select("series_id", "day", F.round("pred", 6).alias("pred"))


@query("q51_svr_conditions", "SELECT DISTINCT o_orderpriority AS series_id, 0.0::DOUBLE AS violation, 0.0::DOUBLE AS balance, true AS converged FROM orders")
def svr_conditions_query(spark, sf_dir):
    """Support vectors: residuals inside the tube without a dual, on it with a free one, outside at a bound; duals add up to 0."""
    y, days = _targets(spark, sf_dir)
    x = materialize(day_vectors_of(days, weekday() / 6, month() / 12, _trend()), "x")
    c, eps = 0.5, 0.1
    fitted = models.fit("svr", x, y, {"C": c, "epsilon": eps, "gamma": 5.0, "tol": 1e-6})
    model = fitted.tables["model"]
    duals = model.select("series_id", "step", F.explode(F.arrays_zip("days", "dual")).alias("d")).select(
        "series_id", "step", F.date_from_unix_date("d.days").alias("day"), F.col("d.dual").alias("b"))
    rows = models.predict(fitted, x, floor=False).join(y, ["series_id", "day", "step"]).join(duals, ["series_id", "day", "step"], "left")
    b, r = F.coalesce("b", F.lit(0.0)), F.col("y") - F.col("pred")
    off = F.when(b == 0, F.greatest(F.abs(r) - eps, F.lit(0.0))).when(F.abs(b) < c, F.abs(r - eps * F.signum(b))).otherwise(F.greatest(eps - r * F.signum(b), F.lit(0.0)))
    worst = rows.groupBy("series_id").agg(F.abs(F.round(F.max(off), 4)).alias("violation"), F.abs(F.round(F.sum(b), 6)).alias("balance"))
    return worst.join(model.groupBy("series_id").agg(F.bool_and("converged").alias("converged")), "series_id")


_FOLDS = _WEEKDAYS + """, f AS (SELECT day, (ntile(5) OVER (ORDER BY day) - 1)::INT AS fold FROM (SELECT DISTINCT day FROM t)),
tf AS (SELECT t.*, f.fold FROM t JOIN f USING (day)), k AS (SELECT unnest(range(5))::INT AS fold),
m AS (SELECT k.fold, series_id, wd, avg(y) AS p FROM tf JOIN k ON tf.fold <> k.fold GROUP BY 1, 2, 3),
s AS (SELECT k.fold, CASE WHEN tf.fold = k.fold THEN 'test' ELSE 'train' END AS split, m.series_id, y, p FROM tf CROSS JOIN k JOIN m ON m.fold = k.fold AND m.series_id = tf.series_id AND m.wd = tf.wd),
r AS (SELECT series_id, fold, split, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS score FROM s GROUP BY 1, 2, 3)"""


def _scores(name: str) -> str:
    return f"WITH {_FOLDS} SELECT '{name}' AS model, series_id, fold, split, score FROM r"


def _search(spark, sf_dir, name: str, params: dict, *features):
    """Scores of all folds; each of these models predicts the weekday means of its training days."""
    y, days = _targets(spark, sf_dir)
    x = materialize(day_vectors_of(days, *features), "x")
    cv = grid_search(name, x, y, [params], n_splits=5)
    return cv.select(F.lit(name).alias("model"), "series_id", "fold", "split", F.round("score", 6).alias("score"))


@query("q42_grid_search_lr", _scores("lr"))
def search_lr_query(spark, sf_dir):
    return _search(spark, sf_dir, "lr", {"fit_intercept": True}, *_flags(weekday(), range(6)))


@query("q42_grid_search_en", _scores("en"))
def search_en_query(spark, sf_dir):
    """A penalty too small to be seen."""
    return _search(spark, sf_dir, "en", {"alpha": 1e-12, "l1_ratio": 0.5, "tol": 1e-10, "max_iter": 100_000}, *_flags(weekday(), range(6)))


@query("q42_grid_search_gp", _scores("gp"))
def search_gp_query(spark, sf_dir):
    """Almost no noise: the process meets the means."""
    return _search(spark, sf_dir, "gp", {"alpha": 1e-9}, weekday())


@query("q42_grid_search_rf", _scores("rf"))
def search_rf_query(spark, sf_dir):
    return _search(spark, sf_dir, "rf", {"n_estimators": 1, "bootstrap": False}, weekday())


@query("q42_grid_search_gbr", _scores("gbr"))
def search_gbr_query(spark, sf_dir):
    return _search(spark, sf_dir, "gbr", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": None}, weekday())


@query("q19_day_matrix_with_gaps", f"""WITH {HOURLY}, e AS (SELECT ts::DATE AS day, hour(ts)::INT AS idx, value FROM hourly WHERE series_id = (SELECT min(series_id) FROM hourly)),
g AS (SELECT d.day, i.idx FROM (SELECT DISTINCT day FROM e) d CROSS JOIN (SELECT DISTINCT idx FROM e) i)
SELECT g.day, (row_number() OVER (PARTITION BY g.day ORDER BY g.idx) - 1)::INT AS idx, e.value AS value FROM g LEFT JOIN e USING (day, idx)""")
def gaps_query(spark, sf_dir):
    """Hours without an event are missing cells: each stays a NULL in its place, the others do not move up."""
    counts = event_counts(spark, sf_dir)
    first = counts.agg(F.min("series_id")).scalar()
    cells = counts.where(F.col("series_id") == first).select(F.to_date("ts").alias("day"), F.hour("ts").alias("idx"), "value")
    return day_vectors(cells).select("day", F.posexplode("x").alias("idx", "value"))
