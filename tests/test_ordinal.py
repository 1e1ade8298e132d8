"""Ordered-threshold fit: derivatives against finite differences, order, optimum, loss against a free fit."""

import numpy as np
import pytest

from rankline.operators import features as FE
from rankline.operators import metrics as M
from rankline.plans import ordinal as OR
from rankline.plans.q_history import FIXTURE_VOCAB
from rankline.plans import models as ML
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def brute_loss(y, x, w, t, every):
    total = 0.0
    for yi, xi in zip(y, x):
        z = float(xi @ w)
        for k in range(1, len(t) + 1):
            if every or k in (yi - 1, yi):
                total += np.logaddexp(0, t[k - 1] - z) if k < yi else np.logaddexp(0, z - t[k - 1])
    return total


@pytest.mark.parametrize("every", [False, True])
def test_derivatives_equal_finite_differences(every):
    rng = np.random.default_rng(4)
    y, x = rng.integers(1, 6, 30), rng.normal(size=(30, 3))
    w, t = rng.normal(size=3), np.sort(rng.normal(size=4))
    s = OR.Sums(w, t, every)
    s.add(y[:11], x[:11])
    s.add(y[11:], x[11:])
    assert s.loss == pytest.approx(brute_loss(y, x, w, t, every))
    u, e = np.concatenate([w, t]), 1e-5

    def grad(u):
        s = OR.Sums(u[:3], u[3:], every)
        s.add(y, x)
        return np.concatenate([s.gw, s.gt])

    for i in range(7):
        up, down = u.copy(), u.copy()
        up[i] += e
        down[i] -= e
        slope = (brute_loss(y, x, up[:3], up[3:], every) - brute_loss(y, x, down[:3], down[3:], every)) / (2 * e)
        assert grad(u)[i] == pytest.approx(slope, abs=1e-6)
        curve = (grad(up) - grad(down)) / (2 * e)
        h = np.concatenate([s.hww[i], s.hwt[:, i]]) if i < 3 else np.concatenate([s.hwt[i - 3], np.eye(4)[i - 3] * s.htt[i - 3]])
        assert curve == pytest.approx(h, abs=1e-6)
    again = OR.Sums(w, t, every).take(s.flat())
    assert again.loss == s.loss and (again.hwt == s.hwt).all() and (again.hww == s.hww).all()


@pytest.mark.parametrize("thresholds", ["immediate", "all"])
def test_fit_recovers_an_ordered_model(spark, thresholds):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    cuts = np.array([-2.0, -0.5, 0.5, 2.0])
    y = 1 + (x @ [1.5, -1.0] + rng.logistic(size=4000) * 0.3 > cuts[:, None]).sum(axis=0)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, Rank int")
    fitted = OR.ordinal_fit(df, ["a", "b"], 5, thresholds=thresholds, reg=1e-4)
    t, w = -np.array(fitted["theta"]), np.array(fitted["w"])
    assert (np.diff(t) >= 0).all() and w[0] > 0 > w[1] and w[0] / -w[1] == pytest.approx(1.5, rel=0.1)
    pred = OR.ordinal_predict(fitted, df)
    assert pred.where("abs(prediction - Rank) <= 1").count() > 3900
    # no small feasible move lowers the loss
    rows = OR.classes(df, 5, 1)
    z = np.array([r["_sharedz"].toArray() for r in fitted["prep"].transform(rows).collect()])
    here = brute_loss(y, z, w, t, thresholds == "all") / 4000
    assert OR.ordinal_loss(fitted, df, thresholds) == pytest.approx(here)
    for i in range(4):
        for e in (-0.02, 0.02):
            moved = t.copy()
            moved[i] += e
            assert brute_loss(y, z, w, np.sort(moved), thresholds == "all") / 4000 >= here - 1e-6


def test_thresholds_are_ordered_where_a_free_fit_is_not(spark):
    feats = FE.rank_features(FE.training_rows(view(spark, SF_SMALL, "rankings")), FIXTURE_VOCAB)
    cols = ML.feature_columns(FIXTURE_VOCAB)
    train = M.time_split(feats).where("split = 'train'").drop("split", "cutoff").cache()
    fitted = OR.ordinal_fit(train, cols, 265)
    t = -np.array(fitted["theta"])
    assert len(t) == 264 and (np.diff(t) >= 0).all()
    # the class shares alone, which are ordered too, do no better
    start = dict(fitted, w=[0.0] * len(cols), theta=(-np.sort(t)).tolist())
    assert OR.ordinal_loss(fitted, train) <= OR.ordinal_loss(start, train) + 1e-9


def test_edges(spark):
    df = spark.createDataFrame([(1.0, 900), (0.0, -5), (0.5, None), (0.3, 2)], "a double, Rank int")
    fitted = OR.ordinal_fit(df, ["a"], 4)
    assert len(fitted["theta"]) == 3 and np.isfinite(fitted["theta"]).all()
    with pytest.raises(ValueError):
        OR.ordinal_fit(df.where("Rank IS NULL"), ["a"], 4)
    with pytest.raises(ValueError):
        OR.ordinal_fit(df, ["a"], 4, thresholds="some")


def test_thresholds_passed_equal_a_plain_count(spark):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(m,) for m in (None, nan, inf, -inf, 0.0, -1.0, 1.5, 2.0, -2.0, 40.0)], "m double")
    for theta in ([1.0], [-1.5, 2.0, 0.0, 2.0], [nan, 1.0, inf, -inf, -3.0], [3.0 - 0.25 * k for k in range(40)]):
        plain = F.size(F.filter(F.array(*[F.lit(t) for t in theta]), lambda t: t + F.col("m") > 0))
        got = df.select("m", plain.alias("want"), OR.thresholds_passed(F.col("m"), theta).alias("got"))
        assert got.where("want <> got").collect() == []


def test_the_margin_is_evaluated_once_a_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    fitted = {"prep": None, "cols": ["a", "b"], "w": [1.0, -0.5], "theta": [2.0, 0.0, -2.0], "n_ranks": 4}
    pred = OR.ordinal_predict(fitted, df)
    assert [r.prediction for r in pred.collect()] == [2.0]
    plan = pred._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" in plan
    # no lambda of the thresholds is open where the margin's terms stand
    opened, depth = [], 0
    for i, c in enumerate(plan[:plan.index("zip_with(")]):
        depth += (c == "(") - (c == ")")
        if c == "(" and plan[:i].endswith("lambdafunction"):
            opened.append(depth)
        opened = [d for d in opened if d <= depth]
    assert opened == []


def test_sums_over_blocks_equal_sums_over_rows(spark):
    rng = np.random.default_rng(7)
    y, big = rng.integers(1, 7, 500), [0.0, 3.0, -128.0, 40_000.0, -2.0 ** 31, 2.0 ** 60]
    x = np.column_stack([rng.integers(-5, 6, 500), rng.choice(big, 500), rng.normal(size=500), rng.integers(0, 300, 500)])
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "_y int, _x array<double>").repartition(3)
    packed, scale = OR.blocks(df, 4).cache(), np.array([0.5, 1e-9, 2.0, 0.0])
    assert packed.count() < 60 and sum(len(r._y) // 4 for r in packed.collect()) == 500
    # each feature in the shortest type that holds it
    assert {r._k for r in packed.collect()} == {"bddh"}
    assert OR.class_counts(packed) == {c: int((y == c).sum()) for c in range(1, 7)}
    w, t = rng.normal(size=4), np.sort(rng.normal(size=5))
    for every in (False, True):
        want, got = OR.Sums(w, t, every), OR.sums(packed, scale, w, t, every)
        want.add(y, x * scale)
        assert np.allclose(got.flat(), want.flat(), rtol=1e-12, atol=1e-12)
        assert want.loss == pytest.approx(brute_loss(y, x * scale, w, t, every))
    packed.unpersist()


def test_blocks_of_empty_and_missing_features(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, nan]), (2, [float("inf"), 2.0])], "_y int, _x array<double>").coalesce(1)
    rows = OR.blocks(df, 2).collect()
    assert [r._k for r in rows] == ["dd"]
    got = np.frombuffer(rows[0]._x, float)
    assert np.isnan(got[1]) and got[[0, 2, 3]].tolist() == [1.0, float("inf"), 2.0]
    assert OR.blocks(df.limit(0), 2).count() == 0


def test_a_vector_of_features_is_fitted_as_its_columns_are(spark):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (300, 3))
    df = spark.createDataFrame([(int(np.clip(a + b, 1, 6)), int(a), int(b), int(c)) for a, b, c in x], "Rank int, a int, b int, c int")
    whole = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    one, two = OR.ordinal_fit(df, ["a", "b", "c"], 6), OR.ordinal_fit(whole, ["x"], 6)
    assert np.allclose(one["w"], two["w"]) and np.allclose(one["theta"], two["theta"])
    predicted = lambda fitted, d: sorted((r.a, r.b, r.c, r.prediction) for r in OR.ordinal_predict(fitted, d).collect())
    assert predicted(one, df) == predicted(two, whole)
