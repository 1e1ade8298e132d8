import itertools
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from rankline.operators import metrics as M


def _pairs(spark, n=300, seed=3, groups=("a", "b")):
    rnd = random.Random(seed)
    rows = [(g, rnd.randint(1, 30), rnd.randint(1, 30) + rnd.random() * 0) for g in groups for _ in range(n)]
    return spark.createDataFrame(rows, "g string, y int, p double"), pd.DataFrame(rows, columns=["g", "y", "p"])


def _kendall_brute(y, p):
    nc = nd = 0
    for i, j in itertools.combinations(range(len(y)), 2):
        s = (y[i] - y[j]) * (p[i] - p[j])
        nc += s > 0
        nd += s < 0
    n0 = len(y) * (len(y) - 1) / 2
    n1 = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    n2 = sum(c * (c - 1) / 2 for c in pd.Series(p).value_counts())
    return (nc - nd) / math.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_matches_brute_force(spark):
    df, pdf = _pairs(spark)
    got = {r.g: r.kendall for r in M.kendall_tau_b(df, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert abs(got[g] - _kendall_brute(sub.y.tolist(), sub.p.tolist())) < 1e-9


def test_kendall_on_unrounded_predictions_over_many_slabs(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.choice((None, *range(1, 12))), rnd.choice((None, 0.5, rnd.gauss(0, 3), rnd.gauss(0, 3))))
            for g in ("a", "b", "c") for _ in range(250)]
    rows += [("one", 1, 1.0), ("flat", 2, 1.0), ("flat", 3, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    pdf = pd.DataFrame(rows, columns=["g", "y", "p"]).dropna()
    want = {g: _kendall_brute(x.y.tolist(), x.p.tolist()) for g, x in pdf.groupby("g") if g in "abc"}
    for slab_cells in (10**6, 100, 7):
        got = {r.g: r.kendall for r in M.kendall_tau_b(df, ["g"], rounded=False, slab_cells=slab_cells).collect()}
        assert got.pop("one") is None and got.pop("flat") is None
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    x = df.where("g = 'a'").drop("g")
    assert abs(M.kendall_tau_b(x, [], rounded=False, slab_cells=20).first().kendall - want["a"]) < 1e-9
    assert M.kendall_tau_b(df.limit(0), [], rounded=False).first().kendall is None
    # two group columns, one of one value
    two = M.kendall_tau_b(df.withColumn("k", F.lit(3)), ["k", "g"], rounded=False, slab_cells=50)
    assert {r.g for r in two.where("kendall IS NOT NULL").collect()} == {"a", "b", "c"}


def test_weighted_inversions():
    import numpy as np
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 64, 130):
        v, w = rng.integers(0, 9, n), rng.integers(1, 5, n).astype(float)
        want = [sum(w[i] for i in range(j) if v[i] > v[j]) for j in range(n)]
        assert M.weighted_inversions(v, w).tolist() == want


def test_kendall_makes_no_grid_of_values(spark):
    df, _ = _pairs(spark)
    cells = M._cells(df, ["g"], "y", "p")
    plan = M.inversions(cells, ["g"], "y", "p", 100)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_spearman_matches_pandas(spark):
    df, pdf = _pairs(spark)
    got = {r.g: r.spearman for r in M.spearman(df, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert abs(got[g] - sub.y.rank().corr(sub.p.rank())) < 1e-9
    rnd = random.Random(1)
    rows = [(rnd.randint(1, 265), rnd.gauss(0, 1)) for _ in range(3000)]
    want = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert abs(M.spearman(spark.createDataFrame(rows, "y int, p double"), []).first().spearman - want) < 1e-9


def test_incomplete_pairs_are_left_out(spark):
    rows = [(1, 2.0), (2, 1.0), (3, 3.0), (4, 4.0), (None, 9.0), (50, None), (None, None)]
    r = M.all_metrics(spark.createDataFrame(rows, "y int, p double"), []).first()
    assert (r.n, r.n_incomplete, r.accuracy_5) == (4, 3, 1.0)
    assert abs(r.r2 - 0.6) < 1e-12 and abs(r.spearman - 0.8) < 1e-12 and abs(r.kendall - 2 / 3) < 1e-12


def test_error_metrics(spark):
    df = spark.createDataFrame([(10, 12.0), (20, 20.0), (30, 24.0)], "y int, p double")
    r = M.error_metrics(df, []).first()
    assert r.n == 3 and abs(r.mae - 8 / 3) < 1e-12 and abs(r.rmse - math.sqrt(40 / 3)) < 1e-12
    var = pd.Series([10, 20, 30]).var(ddof=0)
    assert abs(r.r2 - (1 - 40 / (var * 3))) < 1e-12
    assert (r.accuracy_5, r.accuracy_10) == (2 / 3, 1.0)


def test_constant_prediction_gives_null_correlations(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "y int, p double")
    r = M.all_metrics(df, []).first()
    assert r.spearman is None and r.kendall is None


def test_time_cutoff_exact(spark):
    import datetime as dt
    rnd = random.Random(7)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rnd.randint(0, 10 ** 13)) for _ in range(997)]
    df = spark.createDataFrame([(t,) for t in ts], "UpdateDT timestamp_ntz")
    got = M.time_cutoff(df, fanout=16)
    k = -(-len(ts) * 4 // 5)
    want = sorted(ts)[k - 1]
    epoch = dt.datetime(1970, 1, 1)
    assert got == (want - epoch) // dt.timedelta(microseconds=1)


def test_best_flag_per_eval_set(spark):
    b = spark.createDataFrame([("s1", "A", 3.0), ("s1", "B", 2.0), ("s2", "A", 1.0), ("s2", "B", 5.0)],
                              "eval_set string, model_name string, mae double")
    got = {(r.eval_set, r.model_name): r.is_best_model for r in M.flag_best(b).collect()}
    assert got == {("s1", "A"): False, ("s1", "B"): True, ("s2", "A"): True, ("s2", "B"): False}


def test_merge_leaderboards(spark):
    base = spark.createDataFrame([("RF", 1.0), ("GB", 2.0), ("LR", 3.0)], "model_name string, mae double")
    rep = spark.createDataFrame([("RF", 0.5)], "model_name string, mae double")
    med = spark.createDataFrame([("Median", 47.0)], "model_name string, mae double")
    got = sorted((r.model_name, r.mae) for r in M.merge_leaderboards(base, rep, med).collect())
    assert got == [("GB", 2.0), ("LR", 3.0), ("Median", 47.0), ("RF", 0.5)]
