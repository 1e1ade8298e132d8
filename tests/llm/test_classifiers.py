import math

import pytest

from pyspark.sql import functions as F

from rankline.llm import compress_quality as cq
from rankline.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def held(spark, df, label):
    got = df.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").collect()
    n = {k: [r for r in got if r[label] == k] for k in (0, 1)}
    return {k: sum(r.predicted == k for r in v) / len(v) for k, v in n.items()}


def test_quality_on_held_out_rows(spark):
    out = cq.op8_compress_quality(spark, SF)
    right = held(spark, out, "quality")
    assert right[1] > 0.97 and right[0] > 0.85
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark):
    out = tx.op10_toxicity(spark, SF).cache()
    right = held(spark, out, "toxic")
    assert right[1] > 0.9 and right[0] > 0.96
    # every flagged document names a sentence, and its words are in the text
    assert out.where("predicted = 1 and size(offending) = 0").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    part = out.where("predicted = 1").select("doc_id", F.explode("offending").alias("o")).join(docs, "doc_id")
    assert part.where("o.start < 0 or o.end > length(text) or o.start >= o.end").count() == 0


def test_held_out_ids_teach_nothing(spark, make_docs):
    import zlib
    docs = make_docs([(i, f"text {i}") for i in range(50)])
    kept = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], LABELS)
    sample, numbers = tx.training_sample(docs, labels, "toxic", 100, 1000)
    assert sorted(t for t, _ in sample) == sorted(f"text {i}" for i in kept) and sum(numbers.values()) == len(kept)
    got = {r.doc_id: r.held_out for r in cq.score_documents(docs, labels).collect()}
    assert {i for i, h in got.items() if not h} == set(kept)


def test_the_sample_does_not_depend_on_the_order_of_texts_under_one_id(spark, make_docs):
    rows = [(i, f"text {i} {k}") for i in range(30) for k in range(4)] + [(6, None)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], LABELS)
    samples = [tx.training_sample(make_docs(r).repartition(n), labels, "toxic", 100, 1000) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert samples[0] == samples[1] and len(samples[0][0]) == len({t.split()[1] if t else 6 for t, _ in samples[0][0]})


def test_quality_difference_equals_plain_compression():
    import zstandard
    good = [f"The plain sentence number {i} reads well, and it ends." for i in range(300)]
    bad = [f"$$$ buy %% now {i} ### click |||" for i in range(300)]
    dicts = [cq.build_dictionary(x) for x in (good, bad)]
    differ = cq.Differ(*dicts)
    for text in (None, "", "é", good[0] * 90, bad[0] * 200, "x" * 5000):
        raw = (text or "").encode()
        size = [sum(len(zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)).compress(raw[i:i + cq.PIECE]))
                    for i in range(0, len(raw), cq.PIECE)) for d in dicts]
        by_length, by_sum, _ = differ(text)
        assert by_length == (size[1] - size[0]) / max(1, len(raw)) and by_sum == (size[1] - size[0]) / max(1, sum(size))
    assert differ(good[7])[0] > 0 > differ(bad[7])[0]


def test_quality_calibration_is_the_weighted_optimum():
    import numpy as np
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    weight = {0: 2.0, 1: 0.5}
    mean, scale, w = cq.calibrate([tuple(r) for r in x], y.tolist(), weight)
    a = np.hstack([np.ones((200, 1)), (x - mean) / scale])
    v = np.array([weight[k] for k in y])

    def loss(w):
        z = a @ w
        return (v * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (1e-3 * w[0] ** 2 + 0.1 * (w[1:] ** 2).sum())

    here = loss(np.array(w))
    for i in range(4):
        for e in (-1e-3, 1e-3):
            moved = np.array(w)
            moved[i] += e
            assert loss(moved) >= here


def test_very_long_texts(spark, make_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], LABELS)
    docs = make_docs([(i, f"good text {i}. " if i % 2 else f"b@d t*xt {i}! ") for i in range(40)]
                     + [(100, "word " * 200_000), (101, "x" * 1_000_000)])
    for out in (cq.score_documents(docs, labels), tx.score_documents(docs, labels)):
        got = {r.doc_id: r.score for r in out.collect()}
        assert len(got) == 42 and all(0 <= s <= 1 for s in got.values())


def test_no_labels_and_one_label(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "x y"), (3, "x y"), (3, "x y")])
    none = spark.createDataFrame([], LABELS)
    ones = spark.createDataFrame([(i, 1, 1) for i in range(60)], LABELS)
    assert [r.score for r in cq.score_documents(docs, none).collect()] == [0.5] * 5
    assert all(0.5 < r.score < 1 for r in cq.score_documents(docs, ones).collect())
    assert [r.score for r in tx.score_documents(docs, none).collect()] == [0.0] * 5
    assert cq.score_documents(make_docs([]), none).count() == 0 and tx.score_documents(make_docs([]), none).count() == 0
    assert tx.drop_toxic(docs.withColumn("_toxicity", F.lit(1)), none).count() == 5


def test_noisy_or_of_sentences():
    weights = {}
    scorer = tx.Scorer(-2.0, [0.0] * (1 << tx.BITS))
    scorer.weight = lambda w: weights.get(w, 0.0)
    weights.update(bad=3.0, awful=1.5)
    p, spans = scorer("Good day. bad thing!\nawful one. awful two")
    z = [-2.0, 1.0, -0.5, -0.5]
    assert p == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z))
    assert [s[:2] for s in spans] == [(9, 20)]
    p, spans = scorer("awful one. awful two. awful three.")
    assert p >= 0.5 and len(spans) == 1  # only together do they reach 0.5: the highest is named


def test_training_finds_the_words_that_matter():
    clean = [(f"word{i} is fine. and so is thing{i % 7}.", 0) for i in range(200)]
    toxic = [(f"word{i} is fine. you scumbag{i % 5}. and so on thing{i % 7}.", 1) for i in range(60)]
    model = tx.fit(clean + toxic, {0: 200, 1: 60})
    scorer = tx.Scorer(*model)
    assert scorer("nothing here. you scumbagging one.")[0] > 0.5 > scorer("word3 is fine. and so is thing2.")[0]
    assert scorer("fine. you scumbag1 indeed.")[1][0][0] == 5
    assert tx.fit([], {}) is None and tx.fit(clean, {0: 200}) is None


def test_training_draws_2400_of_each_label(spark, monkeypatch):
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(tx, "fit", lambda sample, numbers: (sample, numbers))
    sample, numbers = tx.train(docs, labels)
    assert min(numbers.values()) > 2400 and [sum(y == k for _, y in sample) for k in (0, 1)] == [2400, 2400]
