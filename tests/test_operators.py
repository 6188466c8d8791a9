import math
import time
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.functions import metrics as M
from tempora.operators import evaluate as E
from tempora.operators import select as S
from tempora.operators.encode import one_hot
from tempora.operators.grid import densify, fill_forward_backward
from tempora.operators.joins import left_join_all, nearest_vectors
from tempora.operators.reshape import align_xy, day_matrix_long, day_vectors, feature_names, rows_from_day_arrays
from tempora.operators.scale import fit_scaler, scale, unscale
from tempora.operators.stats import group_median, pivot_mean
from tempora.operators.windows import kfold, lag_lead, prefix_split, training_folds

T0 = datetime(2017, 1, 1)


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def test_densify_cases(spark):
    rows = [("a", T0, 1.0), ("a", T0 + timedelta(minutes=7), 9.0), ("a", T0 + timedelta(minutes=15), None),
            ("b", T0 + timedelta(days=2), 4.0)]
    got = densify(obs_frame(spark, rows)).collect()
    assert len(got) == 2 * 2 * 96  # two series, two days; 2 January does not occur
    values = {(r.series_id, r.ts): r.value for r in got}
    assert values["a", T0] == 1.0 and values["a", T0 + timedelta(minutes=15)] == 0.0
    assert ("a", T0 + timedelta(minutes=7)) not in values and values["a", T0 + timedelta(days=2)] == 0.0
    assert values["b", T0 + timedelta(days=2)] == 4.0 and sum(values.values()) == 5.0


def test_fill_crosses_days_and_matches_pandas(spark):
    rng = np.random.default_rng(3)
    idx = [T0 + timedelta(hours=5 * i) for i in range(300)]
    a = np.where(rng.random(300) < 0.9, None, rng.integers(0, 50, 300).astype(float))
    b = np.where(np.arange(300) == 200, 7.0, None)
    pdf = pd.DataFrame({"ts": idx, "a": pd.array(a, dtype="Float64"), "b": pd.array(b, dtype="Float64")})
    df = spark.createDataFrame([(t, None if x is None else float(x), None if y is None else float(y)) for t, x, y in zip(idx, a, b)],
                               "ts timestamp_ntz, a double, b double")
    got = fill_forward_backward(df, ["a", "b"]).orderBy("ts").collect()
    want = pdf.ffill().bfill()
    assert [r.a for r in got] == want["a"].tolist() and [r.b for r in got] == want["b"].tolist()


def test_fill_per_series_keeps_series_apart(spark):
    df = spark.createDataFrame([("x", T0, None), ("x", T0 + timedelta(days=1), 5.0), ("y", T0, 1.0), ("y", T0 + timedelta(days=1), None)],
                               "k string, ts timestamp_ntz, v double")
    got = {(r.k, r.ts.day): r.v for r in fill_forward_backward(df, ["v"], keys=["k"]).collect()}
    assert got == {("x", 1): 5.0, ("x", 2): 5.0, ("y", 1): 1.0, ("y", 2): 1.0}


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_lag_lead_matches_shift(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for series, n in (("hot", 500), ("cold", 9), ("tiny", 3)):
        t = T0
        for _ in range(n):
            t += timedelta(minutes=int(rng.integers(1, 200)))
            rows.append((series, t, float(rng.integers(0, 100)), int(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double, p int")
    got = lag_lead(df, ["v", "p"], ["v"], 3, 2, targets=["p"], keys=["s"], block=block).toPandas().sort_values(["s", "ts"])
    parts = []
    for s, g in pd.DataFrame(rows, columns=["s", "ts", "v", "p"]).groupby("s"):
        g = g.sort_values("ts").copy()
        for i in range(3, 0, -1):
            g[f"v::t-{i}"] = g["v"].shift(i)
        for i in (1, 2):
            g[f"v::t+{i}"] = g["v"].shift(-i)
        parts.append(g.iloc[3:len(g) - 2])
    want = pd.concat(parts).sort_values(["s", "ts"])
    assert len(got) == len(want) == 495 + 4
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_lag_lead_rejects_unknown_window(spark):
    df = spark.createDataFrame([(T0, 1.0)], "ts timestamp_ntz, v double")
    with pytest.raises(ValueError):
        lag_lead(df, ["v"], ["w"], 1, 0)


def test_median_of_hot_and_small_groups(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([rng.normal(1e6, 1, 3001), [0.0, 1e12]]), "even": rng.integers(-5, 5, 40).astype(float),
            "one": np.array([3.25]), "same": np.full(7, 2.0), "neg": -rng.exponential(100, 501), "two": np.array([1.0, 4.0]), "small": rng.normal(0, 1e-9, 200),
            "signs": np.concatenate([-rng.exponential(1, 50), [0.0, 0.0], rng.exponential(1e9, 48)]), "zero": np.zeros(4)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for parts in (2, 1024):
        got = {r.k: r.median for r in group_median(df, ["k"], "v", n_parts=parts).collect()}
        assert got == {k: float(np.median(v)) for k, v in data.items()}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(11)
    keys = np.unique(rng.integers(0, 6, (400, 4)).astype(float), axis=0)
    queries = np.unique(np.vstack([rng.integers(0, 9, (80, 4)), np.zeros((1, 4))]).astype(float), axis=0)
    hot = np.array([1.0, 1.0, 1.0, 1.0]) + rng.normal(0, 1e-3, (300, 4)).round(6)  # most keys in one cell
    keys = np.vstack([keys, hot])
    q = spark.createDataFrame([(v.tolist(),) for v in queries], "q array<double>")
    k = spark.createDataFrame([(v.tolist(),) for v in keys], "k array<double>")
    for cells, chunk in ((8, 16), (32, 256), (1, 50)):
        got = {tuple(r.q): (tuple(r.k), r.similarity) for r in nearest_vectors(q, k, cells, chunk).collect()}
        assert len(got) == len(queries)
        for v in queries:
            if not v.any():
                assert got[tuple(v)] == (min(map(tuple, keys)), None)
                continue
            ok = [u for u in keys if u.any()]
            sims = [round(float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v))), 9) for u in ok]
            best = max(sims)
            assert round(got[tuple(v)][1], 9) == pytest.approx(best, abs=2e-9)
            near = [tuple(u) for u, s in zip(ok, sims) if s >= best - 1e-9]
            assert got[tuple(v)][0] in near


def test_nearest_at_embedding_width(spark):
    """40 million pairs of unclustered vectors, where no cell can be ruled out, against one product in memory."""
    rng = np.random.default_rng(5)
    keys, queries = rng.normal(size=(20000, 64)), rng.normal(size=(2000, 64))
    keys[7] = 3 * keys[5]  # parallel keys tie
    queries[0] = 2 * keys[5]
    k = spark.createDataFrame(pd.DataFrame({"k": keys.tolist()}), "k array<double>")
    q = spark.createDataFrame(pd.DataFrame({"q": queries.tolist()}), "q array<double>")
    start = time.monotonic()
    got = {tuple(r.q): (tuple(r.k), r.similarity) for r in nearest_vectors(q, k, chunk=300).collect()}
    assert time.monotonic() - start < 60
    sims = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (keys / np.linalg.norm(keys, axis=1)[:, None]).T
    assert got[tuple(queries[0])] == (min(tuple(keys[5]), tuple(keys[7])), 1.0)
    for v, i, s in zip(queries[1:], sims.argmax(axis=1)[1:], sims.max(axis=1)[1:]):
        assert got[tuple(v)][0] == tuple(keys[i]) and got[tuple(v)][1] == pytest.approx(s, abs=1e-11)


def test_nearest_leaves_other_lengths_out(spark):
    k = spark.createDataFrame([([1.0],), ([1.0, 0.0],), ([0.0, 1.0],), ([math.nan, 1.0],), ([0.0, 0.0],)], "k array<double>")
    q = spark.createDataFrame([([0.2, 1.0],), ([3.0],), ([1.0, 1.0, 1.0],), ([math.nan, 2.0],)], "q array<double>")
    got = {str(r.q): (r.k, r.similarity) for r in nearest_vectors(q, k, 2, 1).collect()}
    assert got["[0.2, 1.0]"][0] == [0.0, 1.0] and got["[3.0]"] == ([1.0], 1.0)
    assert got["[1.0, 1.0, 1.0]"] == ([0.0, 0.0], None)
    assert got["[nan, 2.0]"][0] == [0.0, 1.0] and math.isnan(got["[nan, 2.0]"][1])


def test_nearest_tie_takes_smallest(spark):
    q = spark.createDataFrame([([1.0, 1.0],)], "q array<double>")
    k = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([0.0, 0.0],)], "k array<double>")
    assert nearest_vectors(q, k).first().k == [0.0, 1.0]


def test_left_join_refuses_shared_names(spark):
    a = spark.createDataFrame([(1, 2)], "ts int, v int")
    with pytest.raises(ValueError):
        left_join_all([a, a])


def test_strict_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [r.v for r in S.strict_key_lookup(df, df.where("k = 2"), ["k"]).collect()] == ["b"]
    with pytest.raises(KeyError):
        S.strict_key_lookup(df, spark.createDataFrame([(3,)], "k int"), ["k"])


def test_repairs(spark):
    df = spark.createDataFrame([("Moins de 5", "71634.0"), ("17", "12")], "n string, i string")
    rows = df.select(S.repair_count("n").alias("n"), S.normalise_id("i").alias("i")).collect()
    assert [(r.n, r.i) for r in rows] == [(1, "71634"), (17, "12")]
    r = spark.range(1).select(S.round_half_even(F.lit(2.5), 0).alias("a"), S.round_half_even(F.lit(3.5), 0).alias("b"),
                              S.floor_zero(F.lit(-1.0)).alias("c"), S.fill_zero(F.lit(None).cast("double")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (2.0, 4.0, 0.0, 0.0)


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, o int, v string")
    assert {r.k: r.v for r in S.last_wins(df, ["k"], [F.col("o")]).collect()} == {"a": "y", "b": None}


def test_constant_features(spark):
    rows = [(0, 1.0), (0, 1.0), (1, 1.0), (1, 2.0), (2, None), (2, None), (3, 5.0)]
    x = spark.createDataFrame(rows, "idx int, value double")
    assert sorted(r.idx for r in S.varying_features(x).collect()) == [1, 2]


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "f string")
    out = one_hot(df, ["f"])
    assert out.columns == ["f=a", "f=b"]
    assert sorted(map(tuple, out.collect())) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert one_hot(df, ["f"], drop_last=False, keep_source=True).columns == ["f", "f=a", "f=b", "f=c"]
    with pytest.raises(ValueError):
        one_hot(df.withColumn("a", F.lit(1)), ["f"], name=lambda _, v: v)


def test_scalers(spark):
    df = spark.createDataFrame([("c", 0, 3.0), ("c", 1, 3.0), ("v", 0, 1.0), ("v", 1, 5.0)], "s string, i int, value double")
    std = {r.s: (r["shift"], r["scale"]) for r in fit_scaler(df, "standard", ["s"]).collect()}
    assert std == {"c": (3.0, 1.0), "v": (3.0, 2.0)}
    mm = fit_scaler(df, "minmax", ["s"])
    out = scale(df, mm, ["s"])
    assert {(r.s, r.i): r.value for r in out.collect()} == {("c", 0): 0.0, ("c", 1): 0.0, ("v", 0): 0.0, ("v", 1): 1.0}
    wide = scale(spark.createDataFrame([("v", 9.0)], "s string, value double"), mm, ["s"]).first()
    assert wide.value == 2.0
    assert sorted(map(tuple, unscale(out, mm, ["s"]).collect())) == sorted(map(tuple, df.collect()))
    assert scale(df, None, ["s"]) is df
    with pytest.raises(ValueError):
        fit_scaler(df, "robust", ["s"])


def test_folds(spark):
    days = spark.createDataFrame([(date(2017, 1, 1) + timedelta(days=i),) for i in range(11)], "day date")
    folds = kfold(days, 3)
    assert [r.fold for r in folds.orderBy("day").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    a, b = (sorted((r.day, r.fold) for r in kfold(days, 3, True, seed).collect()) for seed in (1, 1))
    assert a == b != sorted((r.day, r.fold) for r in folds.collect())
    trained = training_folds(folds, 3)
    assert trained.count() == 22 and trained.join(folds, ["day", "fold"]).count() == 0


def test_split_by_place(spark):
    days = spark.createDataFrame([(date(2017, 1, 1) + timedelta(days=i),) for i in range(10)], "day date")
    by_date = [r.is_train for r in prefix_split(days, "2017-01-04", "2017-01-06 23:45:00").orderBy("day").collect()]
    assert by_date == [False] * 3 + [True] * 3 + [False] * 4
    by_place = [r.is_train for r in prefix_split(days, "2017-01-04", "2017-01-06 23:45:00", positional=True).orderBy("day").collect()]
    assert by_place == [True] * 3 + [False] * 7


def test_align_and_day_matrix(spark):
    obs = obs_frame(spark, [("a", T0 + timedelta(hours=6), 2.0), ("a", T0 + timedelta(days=1), 3.0)])
    hours = [T0 + timedelta(hours=6 * i) for i in range(8)]
    feats = spark.createDataFrame([(t, float(i), "d%d" % (i // 4) if i % 4 == 0 else None) for i, t in enumerate(hours)],
                                  "ts timestamp_ntz, load double, kind string")
    out, at_step, at_day = align_xy(obs, feats, ["load"], ["kind"], ["kind"], "00:00:00", "18:00:00", 21600)
    assert (at_step, at_day) == (["load"], ["kind=d0"])
    rows = sorted((r.ts, r.value, r.load, r["kind=d0"]) for r in out.collect())
    assert [r[1] for r in rows] == [0.0, 2.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0]
    assert [r[3] for r in rows] == [1] * 4 + [0] * 4
    x = day_vectors(day_matrix_long(out, at_step, at_day, 4)).orderBy("day").collect()
    assert [r.x for r in x] == [[0.0, 1.0, 2.0, 3.0, 1.0], [4.0, 5.0, 6.0, 7.0, 0.0]]
    assert feature_names(at_step, at_day, 4) == ["load-T0", "load-T1", "load-T2", "load-T3", "kind=d0"]


def test_pivot_mean_averages_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0)], "k string, c string, v double")
    rows = sorted(map(tuple, pivot_mean(df, ["k"], "c", ["x", "y"], ["v"], fill=0.0, separator="").collect()))
    assert rows == [("a", 2.0, 0.0), ("b", 0.0, 5.0)]


def test_rows_from_arrays(spark):
    df = spark.createDataFrame([("a", date(2017, 1, 1), [0.1234567, 2.0005])], "series_id string, day date, pred array<double>")
    rows = rows_from_day_arrays(df, 900, "06:00:00").orderBy("ts").collect()
    assert [(r.ts, r.value) for r in rows] == [(T0 + timedelta(hours=6), 0.123), (T0 + timedelta(hours=6, minutes=15), 2.0)]


def test_metric_rules(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0), (1, 1.0, 4.0), (2, 1.0, 2.0), (3, 10.0, None), (3, 2.0, 2.0)], "g int, o double, p double")
    got = {r.g: r for r in df.groupBy("g").agg(*[c.alias(n) for n, c in M.all_errors(F.col("o"), F.col("p"), 5).items()]).collect()}
    assert (got[1].mse, got[1].mae, got[1].mape_at) == (6.5, 2.5, 20.0) and math.isclose(got[1].rmse, 6.5 ** 0.5)
    assert got[2].mape_at is None and got[2].mae == 1.0
    assert got[3].mse is None and got[3].mape_at is None


def eval_inputs(spark):
    obs = obs_frame(spark, [(s, T0 + timedelta(days=d), float(10 + d)) for s in "ab" for d in range(6)])
    good = obs.select(F.lit("good").alias("model"), "series_id", "ts", (F.col("value") + 1).alias("value"))
    gappy = obs.where("day(ts) <> 2").select(F.lit("gappy").alias("model"), "series_id", "ts", F.col("value"))
    return obs, good.unionByName(gappy)


def test_evaluation_uses_common_times(spark):
    obs, preds = eval_inputs(spark)
    sums = E.error_sums(obs, preds, {"all": ("2017-01-01", "2017-01-05"), "late": ("2017-01-05 00:00:00", None)})
    rows = {(r.window, r.model): r for r in E.global_errors(sums).collect()}
    assert rows["all", "good"].mae == 1.0 and rows["all", "gappy"].mse == 0.0
    assert sums.where("window = 'all'").agg(F.sum("n_cell")).first()[0] == 2 * 2 * 3  # days 1, 3, 4 of two series, two models
    wide = E.series_errors(sums, "mae", ["good", "gappy"], ["b", "a"], {"a": "Alpha", "b": "Beta"})
    got = {(r.window, r["__time_series__"]): (r.good, r.gappy, r["__index__"]) for r in wide.collect()}
    assert got["late", "Alpha"] == (1.0, 0.0, 1) and got["late", "Beta"] == (1.0, 0.0, 0)


def test_missing_prediction_is_null(spark):
    obs, preds = eval_inputs(spark)
    holed = preds.where("not (model = 'good' and series_id = 'a' and ts = timestamp_ntz'2017-01-03 00:00:00')")
    rows = {r.model: r for r in E.global_errors(E.error_sums(obs, holed, {"all": (None, None)})).collect()}
    assert rows["good"].mae is None and rows["good"].mape_at is None and rows["gappy"].mae == 0.0


def test_model_without_a_series_is_null(spark):
    obs, preds = eval_inputs(spark)
    holed = preds.where("not (model = 'good' and series_id = 'a')")
    sums = E.error_sums(obs, holed, {"all": (None, None)}, models=["good", "gappy"])
    rows = {r.model: r for r in E.global_errors(sums).collect()}
    assert rows["good"].rmse is None and rows["gappy"].mae == 0.0
    assert E.error_sums(obs, preds, {"all": (None, None)}, models=["good", "gappy", "absent"]).count() == 0  # no common times


def test_r2_weights(spark):
    y = spark.createDataFrame([("a", date(2017, 1, d + 1), s, float(v)) for s, vs in ((0, [1, 2, 3]), (1, [0, 10, 20])) for d, v in enumerate(vs)],
                              "series_id string, day date, step int, y double")
    p = y.select("series_id", F.lit(0).alias("param_idx"), "day", "step",
                 F.when(F.col("step") == 0, F.lit(2.0)).otherwise(F.col("y")).alias("pred"))
    keys = ["series_id", "param_idx"]
    assert E.r2_scores(y, p, keys, ["series_id"]).first().score == 0.5
    assert math.isclose(E.r2_scores(y, p, keys, ["series_id"], "variance").first().score, 200 / 202)


def test_nearest_vectors_within_each_set(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [0.0, 1.0]), (1, [0.0, 2.0])]
    k = spark.createDataFrame(rows, "fold int, k array<double>")
    asked = [(0, [0.1, 1.0]), (1, [0.1, 1.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])]
    q = spark.createDataFrame(asked, "fold int, q array<double>")
    got = {(r.fold, tuple(r.q)): r.k for r in nearest_vectors(q, k, 2, 1, sets=["fold"]).collect()}
    assert got == {(0, (0.1, 1.0)): [1.0, 1.0], (1, (0.1, 1.0)): [0.0, 1.0], (1, (0.0, 0.0)): [0.0, 1.0], (2, (1.0, 1.0)): None}
