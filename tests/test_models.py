import os
import tempfile

from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.plans import models as ML
from rankline.plans.q_history import FIXTURE_VOCAB
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def _train(spark):
    return FE.rank_features(view(spark, SF_SMALL, "rankings"), FIXTURE_VOCAB)


def test_importances_sum_to_one_and_sorted(spark):
    m = ML.fit(_train(spark), ML.feature_columns(FIXTURE_VOCAB), "Random Forest")
    imp = ML.feature_importance(m).collect()
    assert abs(sum(r.Importance for r in imp) - 1.0) < 1e-6
    assert [r.Importance for r in imp] == sorted((r.Importance for r in imp), reverse=True)
    assert all("Factor" in r.Feature for r in ML.feature_importance(m, 10, True).collect())


def test_save_load_same_scores(spark):
    train = _train(spark)
    cols = ML.feature_columns(FIXTURE_VOCAB)
    m = ML.fit(train, cols, "Gradient Boosting")
    path = os.path.join(tempfile.mkdtemp(), "gbt")
    ML.save_model(m, path, FIXTURE_VOCAB, cols, None)
    m2, meta = ML.load_model(spark, path)
    assert meta["feature_columns"] == cols
    a = ML.score(m, train, ["SubjectID", "UpdateDT"]).orderBy("SubjectID", "UpdateDT").collect()
    b = ML.score(m2, train, ["SubjectID", "UpdateDT"]).orderBy("SubjectID", "UpdateDT").collect()
    assert a == b


def test_ordinal_predictions_in_range(spark):
    train = _train(spark)
    fitted = ML.ordinal_fit(train, ML.feature_columns(FIXTURE_VOCAB), 265, max_iter=10)
    pred = ML.ordinal_predict(fitted, train)
    r = pred.agg(F.min("prediction"), F.max("prediction"), F.count("prediction")).first()
    assert 1 <= r[0] <= r[1] <= 265 and r[2] == train.count()


def test_write_feature_sets(spark):
    from rankline.operators import metrics as M
    feats = M.time_split(_train(spark))
    base = tempfile.mkdtemp()
    ML.write_feature_sets({"enhanced": feats}, base)
    back = spark.read.parquet(os.path.join(base, "feature_set=enhanced"))
    assert sorted(r.split for r in back.select("split").distinct().collect()) == ["test", "train"]
    assert back.count() == feats.count()


def test_ordinal_all_thresholds_binned(spark):
    train = _train(spark)
    fitted = ML.ordinal_fit(train, ML.feature_columns(FIXTURE_VOCAB), 265, max_iter=10, thresholds="all", bin_width=10)
    assert len(fitted["theta"]) == 26
    r = ML.ordinal_predict(fitted, train).agg(F.min("prediction"), F.max("prediction")).first()
    assert 1 <= r[0] <= r[1] <= 265


def test_scoring_takes_the_saved_columns(spark):
    import pytest
    from pyspark.sql import functions as F
    from rankline.streaming.jobs import score_rows
    train = _train(spark)
    cols = ML.feature_columns(FIXTURE_VOCAB)
    folder = tempfile.mkdtemp()
    for name in ("Random Forest", "Gradient Boosting"):
        ML.save_model(ML.fit(train, cols, name), ML.model_path(folder, name), FIXTURE_VOCAB, cols, None)
    hist = view(spark, SF_SMALL, "rankings")
    new = view(spark, SF_SMALL, "inputs")
    model, meta = ML.load_model(spark, ML.model_path(folder, "Random Forest"))
    rows = lambda c, v=FIXTURE_VOCAB: score_rows(hist, new, model, v, "m", columns=c)
    plain = score_rows(hist, new, model, FIXTURE_VOCAB, "m")
    same = rows(meta["feature_columns"])
    assert same.exceptAll(plain).count() == 0 and plain.exceptAll(same).count() == 0
    # a saved column that the features lack is 0; a renamed one leaves the model without its input
    short = rows(meta["feature_columns"], [f for f in FIXTURE_VOCAB if f != "Factor3"])
    zero = score_rows(hist, new.withColumns({f"Driver{i}": F.when(F.col(f"Driver{i}") != "Factor3", F.col(f"Driver{i}")).otherwise("")
                                             for i in range(1, 18)}), model, FIXTURE_VOCAB, "m", columns=meta["feature_columns"])
    a, b = (x.select("event_id", F.round("prediction", 9).alias("p")) for x in (short, zero))
    common = a.join(b.select("event_id"), "event_id", "left_semi")
    assert common.exceptAll(b).count() == 0 and b.count() > 0
    renamed = ["Other" if c == "Factor3" else c for c in meta["feature_columns"]]
    with pytest.raises(Exception, match="Factor3"):
        rows(renamed).count()


def test_vocabulary_limit_is_an_argument(spark):
    import pytest
    from rankline.operators.factors import resolve_vocabulary
    r = view(spark, SF_SMALL, "rankings")
    assert len(resolve_vocabulary(r)) == 17 and len(resolve_vocabulary(r, most=17)) == 17
    with pytest.raises(ValueError):
        resolve_vocabulary(r, most=16)


def test_grid_points_are_fitted_side_by_side(spark):
    train = _train(spark)
    grid = [{"maxDepth": 2, "maxIter": 2}, {"maxDepth": 3, "maxIter": 2}]
    cols = ML.feature_columns(FIXTURE_VOCAB)
    two = ML.tune(train, cols, "Gradient Boosting", grid, parallelism=2).collect()
    one = ML.tune(train, cols, "Gradient Boosting", grid, parallelism=1).collect()
    assert two == one and sum(r.chosen for r in two) == 1


def test_feature_sets_are_dealt_out_and_written_once(spark):
    from rankline.plans.q_models import feature_set_frames
    from testdata import SF_SMALL
    frames = feature_set_frames(spark, SF_SMALL)
    files = {k: frozenset(tr.inputFiles()) for k, (tr, _, _, _) in frames.items()}
    assert all(len(f) >= spark.sparkContext.defaultParallelism for f in files.values())
    assert files["base one-hot"] == files["base PCA"]  # one table for both


def small_events(spark, n: int = 400) -> str:
    """A folder with an events table of ``n`` rows of 20 users, every tenth of a model and a few without a value."""
    folder = tempfile.mkdtemp()
    i = F.col("id")
    spark.range(n).select(i.alias("event_id"), F.timestamp_seconds(1_700_000_000 + i * 7919).cast("timestamp_ntz").alias("ts"),
                          (i % 20).alias("user_id"), F.when(i % 10 == 3, "purchase").otherwise("view").alias("event_type"),
                          F.when(i % 97 != 5, (i * 37 % 250).cast("double")).alias("value"),
                          F.lit("{}").alias("props")).coalesce(1).write.parquet(os.path.join(folder, "events.parquet"))
    return folder


def test_every_learner_is_fitted_whole_on_every_feature_set(spark, monkeypatch):
    from rankline.plans import q_models as Q
    asked = []

    def note(owner, name, call):
        whole = getattr(owner, name)

        def noted(*a, **kw):
            asked.append((name, kw.keys() & {"numTrees", "maxIter", "maxDepth", "rounds", "bins", "leaves", "depth", "max_iter"}))
            return call(whole, *a, **kw)

        monkeypatch.setattr(owner, name, noted)

    # what is asked for is noted, what is fitted is small
    sizes = {"Random Forest": {"numTrees": 1, "maxDepth": 1}, "Gradient Boosting": {"maxIter": 1, "maxDepth": 1}}
    note(Q.ML, "regressor", lambda whole, name, **kw: whole(name, **sizes[name]))
    note(Q.B, "fit", lambda whole, *a, **kw: whole(*a, **{**kw, "rounds": 1}))
    note(Q.ML, "ordinal_fit", lambda whole, *a, **kw: whole(*a, **{**kw, "max_iter": 1}))
    rows = Q.feature_set_leaderboard(spark, small_events(spark)).collect()
    assert {(r.model_name, r.feature_set) for r in rows} == {(m, s) for m in Q.GRID_LEARNERS for s in Q.FEATURE_SETS} | {("Median", "none")}
    assert len({(r.n, r.n_incomplete) for r in rows}) == 1  # all judged on the same rows
    assert sorted(a[0] for a in asked) == ["fit"] * 4 + ["ordinal_fit"] * 4 + ["regressor"] * 8
    assert not any(size for _, size in asked)


def test_learners_of_the_grid_read_one_vector_per_row(spark):
    from multiprocessing.pool import ThreadPool
    from rankline.plans import q_models as Q
    folder = small_events(spark)
    with ThreadPool(4) as pool:
        sets = {k: v() for k, v in Q.feature_set_vectors(spark, folder, pool).items()}
    frames = Q.feature_set_frames(spark, folder)
    assert list(sets) == list(Q.FEATURE_SETS)
    for name, (train, test, cols) in sets.items():
        assert train.columns == test.columns == ["Rank", "older", "x"]
        wide_train, wide_test, names, k = frames[name]
        assert len(cols) == (k or len(names))
        for narrow, wide in ((train, wide_train.where("Rank IS NOT NULL")), (test, wide_test)):
            got = sorted((r.Rank or -1, r.x.toArray().tolist()) for r in narrow.collect())
            if k:
                assert len(got) == wide.count() and all(len(x) == k for _, x in got)
            else:
                assert got == sorted((r.Rank or -1, [float(r[c]) for c in names]) for r in wide.collect())
