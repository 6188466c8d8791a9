from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators.windows import ordinal_index
from tempora.plans.evaluation import evaluate, stack_predictions
from tempora.plans.prediction import Job, fit_predict, optimise_fit_predict, prepare
from tempora.plans.observations import HOUR_SLOTS, clean_profiles, clean_totals, disaggregate, missing_share, observation_table, profile_table
from tempora.session import fresh_path, materialize, work_dir
from tempora.sources import tables as T

T0 = datetime(2017, 1, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(8)
    stamps = [T0 + timedelta(hours=6 * i) for i in range(4 * 28)]
    level = {"a": 10.0, "b": 50.0}
    obs = [(s, t, float(v + 3 * (t.weekday() >= 5) + rng.integers(0, 4))) for s, v in level.items() for t in stamps]
    feats = [(t, t.strftime("%A") if t.hour == 0 else None, float(i)) for i, t in enumerate(stamps)]
    return (materialize(spark.createDataFrame(obs, "series_id string, ts timestamp_ntz, value double")),
            materialize(spark.createDataFrame(feats, "ts timestamp_ntz, day_name string, load double")))


def job(**kw):
    base = dict(estimator="ha", train=("2017-01-01", "2017-01-21 23:45:00"), day_features=["day_name"], one_hot=["day_name"],
                end_time="18:00:00", step_seconds=21600)
    return Job(**{**base, **kw})


def test_prepare_shapes(inputs):
    data = prepare(*inputs, job(step_features=["load"]))
    x = data.x.collect()
    assert len(x) == 28 and {len(r.x) for r in x} == {4 + 6}
    assert data.y.count() == 2 * 28 * 4
    assert data.split.where("is_train").count() == 21


def test_reduce_drops_constant_features(inputs):
    obs, feats = inputs
    with_const = feats.withColumn("flat", F.lit(1.0))
    assert len(prepare(obs, with_const, job(day_features=["day_name", "flat"])).x.first().x) == 6
    assert len(prepare(obs, with_const, job(day_features=["day_name", "flat"], reduce=False)).x.first().x) == 7


@pytest.mark.parametrize("floor", ["original", "scaled"])
def test_floor_before_or_after_unscaling(inputs, floor):
    """With standard scaling, cutting at 0 first means that nothing falls below the training mean."""
    obs, feats = inputs
    preds, _ = fit_predict(obs, feats, job(scaler_y="standard", floor=floor))
    lowest = preds.where("series_id = 'a'").agg(F.min("value")).first()[0]
    mean = min(r.m for r in obs.where("series_id = 'a' and ts < '2017-01-22'").groupBy(F.hour("ts")).agg(F.avg("value").alias("m")).collect())
    assert lowest >= round(mean, 3) - 1e-9 if floor == "scaled" else lowest < mean - 0.1


@pytest.mark.parametrize("estimator, params", [("lr", {}), ("en", {"alpha": 0.01}), ("gp", {"alpha": 0.5, "normalize_y": True}),
                                               ("svr", {"C": 10.0}), ("rf", {"n_estimators": 5, "max_depth": 4}),
                                               ("gbr", {"n_estimators": 5, "max_depth": 3})])
def test_every_estimator_runs_through_the_job(inputs, estimator, params):
    preds, _ = fit_predict(*inputs, job(estimator=estimator), params)
    rows = preds.collect()
    assert len(rows) == 2 * 28 * 4 and all(r.value >= 0 for r in rows)
    obs = {(r.series_id, r.ts): r.value for r in inputs[0].collect()}
    error = np.mean([abs(r.value - obs[r.series_id, r.ts]) for r in rows])
    assert error < 2.5


def test_optimise_job_stores_everything(spark, inputs, tmp_path):
    store = str(tmp_path / "run")
    j = job(estimator="lr", window=("2017-01-01 00:00:00", "2017-01-28 23:45:00"), name="tuned")
    out = optimise_fit_predict(*inputs, j, {"fit_intercept": [True, False]}, n_splits=3, store=store)
    assert out.predictions.count() == 2 * 28 * 4
    assert spark.read.parquet(f"{store}/optimize/tuned/best_params").count() == 2
    assert spark.read.parquet(f"{store}/prediction/2017-01-01_2017-01-28").where("model = 'tuned'").count() == 2 * 28 * 4
    assert T.read_manifest(spark, f"{store}/fit/tuned/manifest")["estimator"] == "lr"
    with pytest.raises(Exception):
        optimise_fit_predict(*inputs, j, {"fit_intercept": [True]}, n_splits=3, store=store)


def test_evaluation_report(spark, inputs, tmp_path):
    obs, _ = inputs
    preds = stack_predictions({"up": obs.withColumn("value", F.col("value") + 1), "same": obs})
    windows = {"train": ("2017-01-01", "2017-01-22"), "test": ("2017-01-22", None)}
    out = evaluate(obs, preds, windows, ["same", "up"], at=5, series=["b", "a"], store=str(tmp_path / "eval"))
    assert {(r.window, r.model): r.mae for r in out["global"].collect()} == {(w, m): float(m == "up") for w in windows for m in ("up", "same")}
    report = T.read_delimited(spark, str(tmp_path / "eval" / "errors_testset"), "model STRING, rmse DOUBLE, mae DOUBLE, mape_at DOUBLE, mse DOUBLE, `at` DOUBLE")
    assert sorted((r.model, r.rmse) for r in report.collect()) == [("same", 0.0), ("up", 1.0)]
    assert {r["__time_series__"]: r["__index__"] for r in out["rmse"].collect()} == {"a": 1, "b": 0}


def raw(spark):
    totals = spark.createDataFrame([("01/02/2017", "10.0", "200", "S1"), ("01/02/2017", "10.0", "Moins de 5", "S1"),
                                    ("02/02/2017", "10.0", "100", "S1"), ("01/02/2017", "?", "7", "S2"), ("01/02/2017", None, "7", "S2"),
                                    ("02/02/2017", "20.0", "50", "S3"), ("02/02/2017", "30", "9", "S4")],
                                   "JOUR string, ID_REFA_LDA string, NB_VALD string, CODE_STIF_ARRET string")
    rows = [(HOUR_SLOTS[h], i, c, p) for i in ("10.0", "20") for c in ("JOHV", "SAHV", "JOVS", "SAVS", "DIJFP") for h, p in ((7, 60.0), (23, 40.0))]
    rows += [("ND", "10.0", "JOHV", 5.0), (HOUR_SLOTS[3], "30", "JOHV", 100.0), (HOUR_SLOTS[3], "?", "JOHV", 1.0), rows[0]]
    profiles = spark.createDataFrame(rows, "TRNC_HORR_60 string, ID_REFA_LDA string, CAT_JOUR string, pourc_validations double")
    days = spark.createDataFrame([(date(2017, 2, 1), "JOHV"), (date(2017, 2, 2), "JOHV")], "day date, category string")
    return totals, profiles, days


def test_disaggregation(spark):
    totals, profiles, days = raw(spark)
    wide = profile_table(clean_profiles(profiles))
    assert {r.series_id for r in wide.collect()} == {"10", "20"} and wide.count() == 10  # series 30 is incomplete
    out = disaggregate(clean_totals(totals), wide, days)
    got = {(r.series_id, r.ts): r.value for r in out.collect()}
    assert len(got) == 2 * 2 * 24
    assert got["10", datetime(2017, 2, 1, 7)] == 201 * 0.6 and got["10", datetime(2017, 2, 2, 23)] == 40.0
    assert got["20", datetime(2017, 2, 1, 7)] == 0.0 and got["20", datetime(2017, 2, 2, 7)] == 30.0
    assert missing_share(out).first()[0] == 25.0
    stations = spark.createDataFrame([("S1", "Metro"), ("S3", "Train"), ("S9", "Metro")], "stop_code string, mode string")
    kept = observation_table(totals, profiles, days, stations, F.col("mode") == "Metro")
    assert {r.series_id for r in kept.select("series_id").distinct().collect()} == {"10"}


def test_sinks(spark, inputs, tmp_path):
    path = str(tmp_path / "t")
    T.write_table(inputs[0], path)
    with pytest.raises(Exception):
        T.write_table(inputs[0], path)
    T.write_table(inputs[0].limit(3), path, force=True)
    assert spark.read.parquet(path).count() == 3
    wide = T.write_wide(inputs[0], str(tmp_path / "w"), ["a", "b"])
    back = T.read_observations(spark, [wide], ["b", "a"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, inputs[0].collect()))
    (tmp_path / "days.csv").write_text("2008-05-01\n2008-05-01\n2008-12-25\n")
    (tmp_path / "periods.csv").write_text("2008-02-01;2008-02-10\n")
    assert T.read_days(spark, str(tmp_path / "days.csv")).distinct().count() == 2
    assert T.read_periods(spark, str(tmp_path / "periods.csv")).first().end_day == date(2008, 2, 10)


def test_work_dir_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(work_dir(spark)) and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_ordinal_index(spark):
    df = spark.createDataFrame([("x",), ("y",)], "s string")
    assert {r.s: r["__index__"] for r in ordinal_index(df, "s", ["y", "x"]).collect()} == {"x": 1, "y": 0}


def test_search_goes_on_after_a_kill_and_past_a_bad_series(spark, monkeypatch):
    from tempora.operators import tune
    rng = np.random.default_rng(3)
    days = [T0.date() + timedelta(days=i) for i in range(30)]
    x = materialize(spark.createDataFrame([(d, [float(d.weekday())]) for d in days], "day date, x array<double>"))
    rows = [(f"s{k}", d, 0, float(rng.normal() + k * d.weekday())) for k in range(6) for d in days]
    y = materialize(spark.createDataFrame(rows, "series_id string, day date, step int, y double"))
    broken = y.withColumn("y", F.when(F.col("series_id") == "s3", F.lit(float("nan"))).otherwise(F.col("y")))
    folder, calls = fresh_path(spark, "ledger"), []
    real = tune.grid_search

    def counted(choice, x, own, *rest):
        calls.append({r.series_id for r in own.select("series_id").distinct().collect()})
        if len(calls) == 2 and stop:
            raise KeyboardInterrupt
        return real(choice, x, own, *rest)

    monkeypatch.setattr(tune, "grid_search", counted)
    stop = True
    with pytest.raises(KeyboardInterrupt):
        tune.resumable_search("lr", x, broken, {"fit_intercept": [True, False]}, folder, n_splits=3, buckets=3)
    done = calls[0]
    calls.clear()
    stop = False
    out = tune.resumable_search("lr", x, broken, {"fit_intercept": [True, False]}, folder, n_splits=3, buckets=3).collect()
    assert calls and not any(done & c for c in calls)
    bad = [r for r in out if r.error]
    assert [r.series_id for r in bad] == ["s3"] and bad[0].score is None and "Error" in bad[0].error
    assert len(out) == 1 + 5 * 2 * 3 * 2
    want = {(r.series_id, r.param_idx, r.fold, r.split): r.score for r in real("lr", x, y.where("series_id <> 's3'"), {"fit_intercept": [True, False]}, 3).collect()}
    assert all(abs(want[r.series_id, r.param_idx, r.fold, r.split] - r.score) < 1e-9 for r in out if not r.error)
    calls.clear()
    assert tune.resumable_search("lr", x, broken, {"fit_intercept": [True, False]}, folder, n_splits=3, buckets=3).count() == len(out) and not calls
    assert {r.series_id for r in tune.best_params(spark.createDataFrame(out)).collect()} == {f"s{k}" for k in (0, 1, 2, 4, 5)}


def test_optimise_job_with_a_ledger(spark, inputs):
    folder = fresh_path(spark, "ledger")
    plain = optimise_fit_predict(*inputs, job(), {"method": ["mean", "median"]}, n_splits=3)
    for _ in range(2):
        run = optimise_fit_predict(*inputs, job(), {"method": ["mean", "median"]}, n_splits=3, ledger=folder)
        assert sorted(map(tuple, run.predictions.collect())) == sorted(map(tuple, plain.predictions.collect()))
