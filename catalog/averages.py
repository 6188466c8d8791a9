"""Historical average: fit, median, refit, nearest tuple, grid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.metrics import all_errors
from tempora.functions.vectors import cosine_similarity
from tempora.operators import models
from tempora.operators.joins import nearest_vectors
from tempora.operators.models import ha
from tempora.operators.stats import group_median
from tempora.operators.tune import best_params, grid_search, resumable_search
from tempora.session import fresh_path, materialize

from .base import (DAILY_DENSE, HOURLY_DENSE, daily_targets, day_vectors_of, hourly_dense, month, query, table, weekday)


@query("q01_ha_hourly_eval", f"""WITH {HOURLY_DENSE}, k AS (
  SELECT *, isodow(day) - 1 AS wd, (isodow(day) >= 6)::INT AS we FROM hdense),
a AS (SELECT series_id, step, wd, avg(value) AS pred FROM k WHERE day <= DATE '2024-01-21' GROUP BY 1, 2, 3),
b AS (SELECT series_id, step, we, avg(value) AS pred FROM k WHERE day <= DATE '2024-01-21' GROUP BY 1, 2, 3),
p AS (SELECT 'weekday' AS model, k.value AS obs, a.pred FROM k JOIN a USING (series_id, step, wd) WHERE day > DATE '2024-01-21'
  UNION ALL SELECT 'weekend', k.value, b.pred FROM k JOIN b USING (series_id, step, we) WHERE day > DATE '2024-01-21')
SELECT model, round(sqrt(avg((pred - obs) ** 2)), 6) AS rmse, round(avg(abs(pred - obs)), 6) AS mae,
  round(100 * avg(CASE WHEN obs >= 2 THEN abs(pred - obs) / obs END), 6) AS mape_at, round(avg((pred - obs) ** 2), 6) AS mse,
  count(*) AS n FROM p GROUP BY model""")
def ha_hourly_eval(spark, sf_dir):
    """Hourly counts: fill gaps, average per (series, hour, kind of day) on three weeks, evaluate on the rest."""
    y = materialize(hourly_dense(spark, sf_dir).select("series_id", "day", "step", F.col("value").alias("y")), "y")
    days = y.select("day").distinct()
    train = F.col("day") <= "2024-01-21"
    scored = None
    for name, feature in (("weekday", weekday()), ("weekend", (weekday() >= 5).cast("int"))):
        x = day_vectors_of(days, feature + 1)
        fitted = models.fit("ha", x.where(train), y.where(train), {"method": "mean"})
        pred = models.predict(fitted, x.where(~train)).withColumn("model", F.lit(name))
        scored = pred if scored is None else scored.unionByName(pred)
    pairs = scored.join(y, ["series_id", "day", "step"])
    errors = all_errors(F.col("y"), F.col("pred"), at=2)
    return pairs.groupBy("model").agg(*[F.round(c, 6).alias(n) for n, c in errors.items()], F.count(F.lit(1)).alias("n"))


def _xy(spark, sf_dir):
    y = materialize(daily_targets(spark, sf_dir), "y")
    return day_vectors_of(y.select("day").distinct(), weekday() + 1, month()), y


def _model_rows(fitted):
    return ha.as_table(fitted).select("series_id", F.col("x")[0].cast("int").alias("wd"), F.col("x")[1].cast("int").alias("mon"),
                                         F.round("pred", 6).alias("pred"))


_TUPLES = DAILY_DENSE + ", t AS (SELECT series_id, day, value, isodow(day)::INT AS wd, month(day)::INT AS mon FROM ddense)"


@query("q25_ha_mean", f"WITH {_TUPLES} SELECT series_id, wd, mon, round(avg(value), 6) AS pred FROM t GROUP BY 1, 2, 3")
def ha_mean_query(spark, sf_dir):
    return _model_rows(models.fit("ha", *_xy(spark, sf_dir), {"method": "mean"}))


@query("q25_ha_median", f"WITH {_TUPLES} SELECT series_id, wd, mon, round(median(value), 6) AS pred FROM t GROUP BY 1, 2, 3")
def ha_median_query(spark, sf_dir):
    return _model_rows(models.fit("ha", *_xy(spark, sf_dir), {"method": "median"}))


@query("q25_ha_median_large_groups", """SELECT l_returnflag, round(median(l_extendedprice), 6) AS median_price FROM lineitem GROUP BY 1""")
def ha_median_large_query(spark, sf_dir):
    """The same exact median where a few groups hold all rows."""
    out = group_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "median_price")
    return out.withColumn("median_price", F.round("median_price", 6))


@query("q26_ha_refit_merge", f"""WITH {_TUPLES},
old AS (SELECT series_id, wd, mon, avg(value) AS pred FROM t WHERE year(day) <= 1997 GROUP BY 1, 2, 3),
new AS (SELECT series_id, wd, mon, avg(value) AS pred FROM t WHERE year(day) = 1998 AND month(day) <= 5 GROUP BY 1, 2, 3)
SELECT series_id, wd, mon, round(coalesce(new.pred, old.pred), 6) AS pred FROM old FULL JOIN new USING (series_id, wd, mon)""")
def ha_refit_query(spark, sf_dir):
    """A second fit on five later months replaces their tuples; the other months keep the first fit."""
    x, y = _xy(spark, sf_dir)
    first, second = F.year("day") <= 1997, (F.year("day") == 1998) & (F.month("day") <= 5)
    old = models.fit("ha", x.where(first), y.where(first))
    return _model_rows(ha.refit(old, models.fit("ha", x.where(second), y.where(second))))


@query("q27_ha_nearest", f"""WITH {_TUPLES}, m AS (SELECT series_id, wd, mon, avg(value) AS pred FROM t
  WHERE day < DATE '1996-11-01' AND month(day) <= 10 GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT wd, mon FROM m), q AS (SELECT DISTINCT wd, mon FROM t WHERE year(day) >= 1997),
near AS (SELECT q.wd, q.mon, k.wd AS kwd, k.mon AS kmon, row_number() OVER (PARTITION BY q.wd, q.mon ORDER BY
    (q.wd = k.wd AND q.mon = k.mon) DESC,
    round((q.wd * k.wd + q.mon * k.mon) / (sqrt(q.wd * q.wd + q.mon * q.mon) * sqrt(k.wd * k.wd + k.mon * k.mon)), 12) DESC, k.wd, k.mon) AS rn
  FROM q CROSS JOIN k)
SELECT m.series_id, t.day, round(m.pred, 6) AS pred FROM t JOIN near n ON n.wd = t.wd AND n.mon = t.mon AND rn = 1
JOIN m ON m.series_id = t.series_id AND m.wd = n.kwd AND m.mon = n.kmon WHERE year(t.day) >= 1997""")
def ha_nearest_query(spark, sf_dir):
    """November and December were never seen in training; their days use the most similar known tuple."""
    x, y = _xy(spark, sf_dir)
    seen = (F.col("day") < "1996-11-01") & (F.month("day") <= 10)
    fitted = models.fit("ha", x.where(seen), y.where(seen))
    pred = models.predict(fitted, x.where(F.year("day") >= 1997))
    return pred.select("series_id", "day", F.round("pred", 6).alias("pred"))


_V = "[e::DOUBLE FOR e IN embedding]"


@query("q27_nearest_vectors", f"""WITH v AS (SELECT vec_id, label, {_V} AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, list_cosine_similarity(q.e, k.e) AS s FROM v q JOIN v k ON q.label = 0 AND k.label <> 0)
SELECT query_id, key_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, key_id) AS rn FROM p) WHERE rn = 1""")
def nearest_vectors_query(spark, sf_dir):
    """For each vector of one label the most similar vector of the others."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q, k = v.where(F.col("label") == 0), v.where(F.col("label") != 0)
    near = nearest_vectors(q.select(F.col("e").alias("q")), k.select(F.col("e").alias("k")))
    ids = k.groupBy(F.col("e").alias("k")).agg(F.min("vec_id").alias("key_id"))
    return (q.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")).join(near, "q").join(ids, "k")
            .select("query_id", "key_id", F.round("similarity", 6).alias("similarity")))


@query("q27_cosine_pairs", f"""WITH v AS (SELECT vec_id, {_V} AS e FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs_query(spark, sf_dir):
    """Similarity of each vector to the next one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(following, "vec_id").select("vec_id", F.round(cosine_similarity(F.col("e"), F.col("f")), 6).alias("similarity"))


_CV = _TUPLES + """, f AS (SELECT day, (ntile(5) OVER (ORDER BY day) - 1)::INT AS fold FROM (SELECT DISTINCT day FROM t)),
tf AS (SELECT t.*, f.fold FROM t JOIN f USING (day)), k AS (SELECT unnest(range(5))::INT AS fold),
m AS (SELECT k.fold, series_id, wd, mon, avg(value) AS p0, median(value) AS p1 FROM tf JOIN k ON tf.fold <> k.fold GROUP BY 1, 2, 3, 4),
s AS (SELECT k.fold, CASE WHEN tf.fold = k.fold THEN 'test' ELSE 'train' END AS split, m.series_id, value, p0, p1
  FROM tf CROSS JOIN k JOIN m ON m.fold = k.fold AND m.series_id = tf.series_id AND m.wd = tf.wd AND m.mon = tf.mon),
r AS (SELECT series_id, fold, split, 1 - sum((value - p0) ** 2) / (var_pop(value) * count(*)) AS s0,
  1 - sum((value - p1) ** 2) / (var_pop(value) * count(*)) AS s1 FROM s GROUP BY 1, 2, 3),
cv AS (SELECT series_id, 0 AS param_idx, fold, split, s0 AS score FROM r UNION ALL SELECT series_id, 1, fold, split, s1 FROM r)"""


def _search(spark, sf_dir):
    x, y = _xy(spark, sf_dir)
    return grid_search("ha", x, y, {"method": ["mean", "median"]}, n_splits=5)


@query("q42_grid_search_ha", f"WITH {_CV} SELECT series_id, param_idx, fold, split, round(score, 6) AS score FROM cv")
def grid_search_query(spark, sf_dir):
    return _search(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("q42_resumable_search", f"WITH {_CV} SELECT series_id, param_idx, fold, split, round(score, 6) AS score FROM cv")
def resumable_search_query(spark, sf_dir):
    """The same scores from a ledger that two buckets of series were committed to."""
    x, y = _xy(spark, sf_dir)
    out = resumable_search("ha", x, y, {"method": ["mean", "median"]}, fresh_path(spark, "ledger"), n_splits=5, buckets=2)
    return out.drop("error").withColumn("score", F.round("score", 6))


_UNSEEN = DAILY_DENSE + """, t AS (SELECT series_id, day, value, (year(day) - 1990)::INT AS yr, month(day)::INT AS mon FROM ddense),
f AS (SELECT day, (ntile(5) OVER (ORDER BY day) - 1)::INT AS fold FROM (SELECT DISTINCT day FROM t)),
tf AS (SELECT t.*, f.fold FROM t JOIN f USING (day)), k AS (SELECT unnest(range(5))::INT AS fold),
m AS (SELECT k.fold, series_id, yr, mon, avg(value) AS p0 FROM tf JOIN k ON tf.fold <> k.fold GROUP BY 1, 2, 3, 4),
have AS (SELECT DISTINCT fold, yr, mon FROM m), need AS (SELECT DISTINCT fold, yr, mon FROM tf),
near AS (SELECT n.fold, n.yr, n.mon, h.yr AS hyr, h.mon AS hmon, row_number() OVER (PARTITION BY n.fold, n.yr, n.mon ORDER BY
    (n.yr = h.yr AND n.mon = h.mon) DESC,
    round((n.yr * h.yr + n.mon * h.mon) / (sqrt(n.yr * n.yr + n.mon * n.mon) * sqrt(h.yr * h.yr + h.mon * h.mon)), 12) DESC, h.yr, h.mon) AS rn
  FROM need n JOIN have h ON h.fold = n.fold),
s AS (SELECT tf.fold, tf.series_id, value, p0 FROM tf JOIN near n ON n.fold = tf.fold AND n.yr = tf.yr AND n.mon = tf.mon AND rn = 1
  JOIN m ON m.fold = tf.fold AND m.series_id = tf.series_id AND m.yr = n.hyr AND m.mon = n.hmon)"""


@query("q42_grid_search_unseen", f"""WITH {_UNSEEN} SELECT series_id, fold, round(1 - sum((value - p0) ** 2) / (var_pop(value) * count(*)), 6) AS score
FROM s GROUP BY 1, 2""")
def grid_search_unseen_query(spark, sf_dir):
    """Features are year and month, so most days of a held-out fold have a tuple that its models never saw."""
    y = materialize(daily_targets(spark, sf_dir), "y")
    x = day_vectors_of(y.select("day").distinct(), F.year("day") - 1990, month())
    cv = grid_search("ha", x, y, {"method": ["mean"]}, n_splits=5, train_score=False)
    return cv.select("series_id", "fold", F.round("score", 6).alias("score"))


@query("q42_best_params", f"""WITH {_CV}, a AS (SELECT series_id, param_idx, avg(score) AS score FROM cv WHERE split = 'test' GROUP BY 1, 2)
SELECT series_id, param_idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, param_idx) AS rn FROM a) WHERE rn = 1""")
def best_params_query(spark, sf_dir):
    return best_params(materialize(_search(spark, sf_dir), "cv")).withColumn("score", F.round("score", 6))
