"""Quality by compression: zstandard dictionaries built from good and from bad texts.

A text is cut into pieces of ``PIECE`` bytes, each piece is compressed once with the dictionary
of the good texts and once with that of the bad ones, and the compressed sizes are added up.
Cutting keeps the dictionaries in play over the whole of a long text.  The difference of the
two sums, normalised by the text's size and by the sums themselves, is calibrated to the
probability of label 1 by a logistic curve; the curve also takes in how far the text compresses
at all, since the same difference means more for a text that is nearly all repeats.

The labelled sample is split: 70 % build the dictionaries, the rest calibrates, with weights
that restore the share of each label among all labelled rows.

Plan: at most ``PER_CLASS`` texts per label of at most ``MAX_CHARS`` characters are collected
(documented bounds); two dictionaries and ten numbers are broadcast; every text is scored by
one row-local Arrow function, without a shuffle.

Defined results: NULL and empty texts get the score of no evidence (difference 0).  With no
label at all every score is 0.5; with labels of one kind only, the smoothed share of label 1.
Repeated rows are each scored, alike; other columns, whatever their names, are ignored by
``score_documents``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import held_out, table, training_sample
from rankline.llm.registry import register

PER_CLASS = 1200
MAX_CHARS = 20_000
PIECE = 1024
DICTIONARY = 65_536
LEVEL = 3


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def build_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the texts; their raw bytes where they are too few to train one."""
    import zstandard
    samples = [p for t in texts for p in pieces(t.encode()) if len(p) >= 16]
    if sum(map(len, samples)) >= 10 * DICTIONARY:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    return b"".join(samples)[:DICTIONARY]


class Differ:
    """Compressed sizes of a text under the two dictionaries: their normalised differences and
    the logarithm of their mean share of the text's size."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard
        self.sizes = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.sizes.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d).compress)

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        raw = (text or "").encode()
        good, bad = (sum(len(f(p)) for p in pieces(raw)) for f in self.sizes)
        share = math.log((good + bad + 8) / (2 * len(raw) + 8))
        return (bad - good) / max(1, len(raw)), (bad - good) / max(1, bad + good), share


def calibrate(x: list[tuple[float, ...]], y: list[int], weight: dict[int, float]) -> tuple[list, list, list]:
    """Weighted logistic regression on the standardised inputs: (means, scales, weights)."""
    import numpy as np
    a, t = np.array(x, float), np.array(y, float)
    mean, scale = a.mean(axis=0), a.std(axis=0) + 1e-9
    p = np.hstack([np.ones((len(a), 1)), (a - mean) / scale])
    v = np.array([weight[k] for k in y])
    w = np.zeros(p.shape[1])
    penalty = np.diag([1e-3, 0.1, 0.1, 0.1])

    def loss(w):
        z = p @ w
        return float((v * (np.logaddexp(0, z) - t * z)).sum() + 0.5 * w @ penalty @ w)

    for _ in range(100):  # Newton steps, halved until the loss falls
        q = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30)))
        step = np.linalg.solve((p * (v * q * (1 - q))[:, None]).T @ p + penalty, p.T @ (v * (q - t)) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size * float(abs(step).max()) < 1e-9:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS,
        max_chars: int = MAX_CHARS) -> tuple:
    """(good dictionary, bad dictionary, calibration), or (None, None, score) without two texts of each label."""
    sample, numbers = training_sample(documents, labels, label, per_class, max_chars)
    by = {k: [t for t, y in sample if y == k] for k in (0, 1)}
    if min(map(len, by.values())) < 2:
        n0, n1 = numbers.get(0, 0), numbers.get(1, 0)
        return None, None, (n1 + 1) / (n0 + n1 + 2)
    cut = {k: min(len(by[k]) - 1, int(0.7 * len(by[k]))) for k in (0, 1)}
    good, bad = build_dictionary(by[1][:cut[1]]), build_dictionary(by[0][:cut[0]])
    differ = Differ(good, bad)
    rest = [(t, k) for k in (0, 1) for t in by[k][cut[k]:]]
    weight = {k: numbers[k] / (len(by[k]) - cut[k]) * len(rest) / sum(numbers.values()) for k in (0, 1)}
    return good, bad, calibrate([differ(t) for t, _ in rest], [k for _, k in rest], weight)


def score(text: Column, model: tuple, spark: SparkSession) -> Column:
    """Probability of label 1 for whole texts."""
    if model[0] is None:
        return F.lit(float(model[2]))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts):
        import pyarrow as pa
        good, bad, (mean, scale, w) = shared.value
        differ, out = Differ(good, bad), []
        for t in texts:
            z = w[0] + sum(c * (x - m) / s for c, x, m, s in zip(w[1:], differ(t.as_py()), mean, scale))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    return run(text)


def score_documents(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    s = score(F.col("text"), fit(documents, labels, label), documents.sparkSession)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@register("op8_compress_quality")
def op8_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
