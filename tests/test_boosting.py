"""Histogram boosting against plain trees: gains, growth, missing values, independence of the partitioning, halving."""

import itertools
import json
import math
import random

import numpy as np
import pytest

from rankline.operators import features as FE
from rankline.operators import metrics as M
from rankline.plans import boosting as B
from rankline.plans import models as ML
from rankline.plans.q_history import FIXTURE_VOCAB
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def table(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rnd.randint(0, 9), rnd.choice((None, 1.0, 2.0, 5.0)), rnd.randint(0, 3)
        y = 10 * (a > 4) + (7 if b is None else 0) + 3 * (a > 4) * c + rnd.randint(0, 2)
        rows.append((float(a), b, float(c), y))
    return rows, spark.createDataFrame(rows, "a double, b double, c double, Rank int")


def brute_root(rows, start, l2, least=0.0):
    """Best gain of every column by trying every threshold and both sides for missing values."""
    g = [start - r[3] for r in rows]
    score = lambda s, n: s * s / (n + l2)
    out = {}
    for j, name in enumerate("abc"):
        values = sorted({r[j] for r in rows if r[j] is not None})
        best = 0.0
        for cut, missing_left in itertools.product(values, (False, True)):
            left = [i for i, r in enumerate(rows) if (missing_left if r[j] is None else r[j] <= cut)]
            gl, nl = sum(g[i] for i in left), len(left)
            if min(nl, len(rows) - nl) > least:
                best = max(best, (score(gl, nl) + score(sum(g) - gl, len(rows) - nl) - score(sum(g), len(rows))) / 2)
        out[name] = best
    return out


def test_root_gains_equal_a_plain_search(spark):
    rows, df = table(spark)
    start = float(np.median([r[3] for r in rows]))
    got = dict(B.root_gains(df, ["a", "b", "c"], l2=2.0))
    want = brute_root(rows, start, 2.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def brute_tree(x, g, h, idx, depth, l2, least):
    """Plain recursive tree on the exact values; returns the value of every row."""
    G, H = g[idx].sum(), h[idx].sum()
    out = {i: -G / (H + l2) for i in idx}
    best = None
    for j in range(x.shape[1]):
        for cut, ml in itertools.product(sorted(set(x[~np.isnan(x[:, j]), j])), (False, True)):
            left = np.array([i for i in idx if (ml if math.isnan(x[i, j]) else x[i, j] <= cut)], int)
            right = np.setdiff1d(idx, left)
            if not len(left) or not len(right) or h[left].sum() < least or h[right].sum() < least:
                continue
            gain = (g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - G * G / (H + l2)) / 2
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, left, right
    if best and depth:
        out = {**brute_tree(x, g, h, best[1], depth - 1, l2, least), **brute_tree(x, g, h, best[2], depth - 1, l2, least)}
    return out


@pytest.mark.parametrize("loss", ["squared", "huber"])
def test_a_whole_tree_equals_a_plain_one(spark, loss):
    rows, df = table(spark, 150, 3)
    x = np.array([[math.nan if v is None else v for v in r[:3]] for r in rows])
    y = np.array([float(r[3]) for r in rows])
    start = float(np.median(y))
    g, h = B.derivatives(y, np.full(len(y), start), loss, 3.0)
    want = brute_tree(x, g, h, np.arange(len(y)), 3, 1.0, 4.0)
    model = B.fit(df, ["a", "b", "c"], rounds=1, depth=3, leaves=99, rate=1.0, l2=1.0, least=4.0, loss=loss, delta=3.0)
    assert model.predict(x) - start == pytest.approx([want[i] for i in range(len(y))])


def test_trees_do_not_depend_on_the_partitioning_and_can_be_saved(spark, tmp_path):
    _, df = table(spark, 300, 5)
    cols = ["a", "b", "c"]
    one = B.fit(df.coalesce(1), cols, rounds=B.KEEP + 3)
    two = B.fit(df.repartition(7), cols, rounds=B.KEEP + 3)
    assert [t.nodes for t in one.trees] == [t.nodes for t in two.trees]
    one.save(spark, f"{tmp_path}/m")
    back = B.Boosted.load(spark, f"{tmp_path}/m")
    a, b = (m.transform(df).agg({"prediction": "sum"}).first()[0] for m in (one, back))
    assert a == b and sum(one.importances().values()) == pytest.approx(1.0) and one.importances()["a"] > 0.2


def test_leaf_budget_and_edges(spark):
    _, df = table(spark)
    model = B.fit(df, ["a", "b", "c"], rounds=2, leaves=4)
    assert all(sum(n["feature"] < 0 for n in t.nodes) <= 4 for t in model.trees)
    flat = B.fit(df.withColumn("Rank", df.Rank * 0 + 5), ["a", "b"], rounds=2)
    assert {r.prediction for r in flat.transform(df).collect()} == {5.0}
    with pytest.raises(ValueError):
        B.fit(df.where("Rank < 0"), ["a"], rounds=1)
    nothing = flat.transform(df.limit(0))
    assert nothing.count() == 0 and "prediction" in nothing.columns


def test_halving_chooses_what_the_whole_grid_chooses(spark):
    feats = FE.rank_features(FE.training_rows(view(spark, SF_SMALL, "rankings")), FIXTURE_VOCAB).cache()
    cols = ML.feature_columns(FIXTURE_VOCAB)
    grid = [{"rate": 0.05, "leaves": 4}, {"rate": 0.9, "leaves": 24, "least": 1.0}, {"rate": 0.2, "leaves": 6}, {"rate": 0.6, "leaves": 24}]
    halved = B.tune(feats, cols, grid, rounds=8, rungs=3).collect()
    whole = B.tune(feats, cols, grid, rounds=8, rungs=1).collect()
    assert [r.chosen for r in halved] == [r.chosen for r in whole] and sum(r.chosen for r in halved) == 1
    assert sorted(r.rounds for r in halved) == [2, 2, 4, 8] and {r.rounds for r in whole} == {8}
    chosen = next(r for r in halved if r.chosen)
    assert json.loads(chosen.params) in grid
    assert chosen.validation_mae == next(r for r in whole if r.chosen).validation_mae


def test_fits_of_a_rung_overlap(spark, monkeypatch):
    import threading
    _, df = table(spark)
    df = df.withColumn("UpdateDT", __import__("pyspark.sql.functions", fromlist=["x"]).expr(
        "timestamp_ntz'2022-01-01' + make_interval(0, 0, 0, cast(a as int))"))
    running, most, lock, real = [0], [0], threading.Lock(), B.histograms

    def counted(*a):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return real(*a)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(B, "histograms", counted)
    B.tune(df, ["a", "b"], [{"rate": 0.1}, {"rate": 0.2}, {"rate": 0.3}], rounds=2, rungs=2)
    assert most[0] > 1


def test_a_vector_of_features_gives_the_trees_of_the_columns(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F
    rows, df = table(spark, 600, 9)
    # columns that mostly have one value, and one with more values than are counted one by one
    df = df.withColumns({"d": (F.col("a") == 3).cast("double"), "e": F.when(F.col("c") > 0, 0.0).otherwise(F.col("a")),
                         "f": F.monotonically_increasing_id().cast("double")}).cache()
    cols = ["a", "b", "c", "d", "e"]
    whole = VectorAssembler(inputCols=cols, outputCol="x", handleInvalid="keep").transform(df).select("Rank", "x")
    one, two = B.fit(df, cols, rounds=B.KEEP + 2), B.fit(whole, cols, rounds=B.KEEP + 2, vector="x")
    by_columns = {tuple(r) for r in one.transform(df).select("Rank", *cols, F.round("prediction", 9)).collect()}
    assert {tuple(r[:1]) + tuple(None if v != v else float(v) for v in r[1]) + (r[2],)
            for r in two.transform(whole).select("Rank", "x", F.round("prediction", 9)).collect()} == by_columns
    assert one.importances().keys() == two.importances().keys()
    f = VectorAssembler(inputCols=["d", "f"], outputCol="x").transform(df)
    edges = B.vector_edges(f, "x", 2, bins=4)
    assert edges[0] == [0.0] and len(edges[1]) == 3
    df.unpersist()


def test_sums_of_some_leaves_with_and_without_common_bins_are_equal(spark):
    _, df = table(spark, 500, 11)
    cols = ["a", "b", "c"]
    rows = B.binned(df, cols, B.bin_edges(df, cols), 10.0)
    tree = B.Tree()
    left, right = tree.split(0, {"feature": 0, "bin": 4, "missing_left": False, "gain": 1.0, "left_value": 0.0, "right_value": 0.0})
    args = rows, [], tree, [left, right], 3, 64, "huber", 10.0
    plain, rest = B.histograms(*args), B.histograms(*args, [2, -1, 1])
    assert (plain == rest).all() and plain[..., 2].sum() == 3 * 500
    whole = B.histograms(rows, [], B.Tree(), [0], 3, 64, "huber", 10.0)
    assert (whole[0] - plain[0] == plain[1]).all()  # what is left of a leaf's sums are the other leaf's


def test_a_pass_is_not_dealt_out_over_all_shuffle_partitions(spark, capsys):
    from rankline.session import summed
    parts = spark.range(100).selectExpr("id % 7 AS cell", "1.0D AS g")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "173")
    try:
        summed(parts, "cell", "g").explain()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and ", 173)" not in plan and f", {spark.sparkContext.defaultParallelism})" in plan
