"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a score, the logistic of a bias and the
weights of its words' features (the word, and its first four, five and six letters); the
document's score is the noisy-or of its sentences, 1 - prod(1 - p).  The weights are learned
from document labels alone: the gradient reaches each sentence through the noisy-or.  Each
pass leaves out a random half of the features (with a fixed seed), so that one feature of a
sentence has to suffice.  Afterwards the sentences that offend are told by their own scores.

Plan: at most ``PER_CLASS`` texts per label of at most ``MAX_CHARS`` characters are collected
(documented bounds) and fitted with numpy on the driver; one vector of 2^``BITS`` weights is
broadcast; all texts are scored whole by a row-local Arrow function, without a shuffle.

Defined results: a NULL or empty text is one empty sentence, whose score is that of the bias.
Without a label 1 to learn from, every score is 0.  Repeated rows are each scored, alike; a
score of exactly the threshold counts as toxic.  Other columns, whatever their names, are ignored
by ``score_documents`` and kept by ``drop_toxic``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, held_out, table, training_sample
from rankline.llm.registry import register

PER_CLASS = 2400
MAX_CHARS = 20_000
BITS = 18
STEPS = 120
# Words whose weight a worker keeps (a bound on memory only).
WORD_MEMO = 300_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
EDGES = ".,;:!?\"'()[]{}|#*$%&<>«»¿¡-"


def sentences(text: str) -> list[tuple[int, int]]:
    """Character spans of the sentences."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


def features(word: str) -> tuple[int, ...]:
    """Hashed features of one word."""
    x = word.strip(EDGES).lower()
    if not x:
        return ()
    names = {"w " + x} | {"p" + x[:k] for k in (4, 5, 6) if len(x) > k}
    return tuple(sorted({zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names}))


def fit(sample: list[tuple[str, int]], numbers: dict[int, int]):
    """(bias, weights): full-batch Adam on the weighted log-loss of the noisy-or; None without both labels."""
    import numpy as np
    y = np.array([k for _, k in sample], float)
    if not y.any() or y.all():
        return None
    feature, sentence, document = array("i"), array("i"), array("i")
    in_documents = np.zeros(1 << BITS, np.int32)
    for d, (text, _) in enumerate(sample):
        met: set[int] = set()
        for a, b in sentences(text):
            for word in set(text[a:b].split()):
                got = features(word)
                met.update(got)
                feature.extend(got)
                sentence.extend([len(document)] * len(got))
            document.append(d)
        in_documents[list(met)] += 1
    # features of too few documents are noise: they keep weight 0
    common = in_documents >= max(2, min(8, len(y) // 200))
    feature, sentence, document = (np.frombuffer(x, np.int32) for x in (feature, sentence, document))
    kept = common[feature]
    feature, sentence = feature[kept], sentence[kept]
    nd, ns, total = len(y), len(document), sum(numbers.values())
    # weights that restore the share of each label among all labelled rows
    share = np.where(y == 1, numbers[1] / total / y.mean(), numbers[0] / total / (1 - y.mean()))
    rng = np.random.default_rng(42)
    w, m, v = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, mb, vb = -6.0, 0.0, 0.0
    for step in range(1, STEPS + 1):
        kept = rng.integers(0, 2, len(feature), np.uint8).astype(bool)
        f, s = feature[kept], sentence[kept]
        z = bias + np.bincount(s, w[f], ns)
        none = np.exp(-(np.bincount(document, np.logaddexp(0, z), nd) + 1e-9))  # probability of no toxic sentence
        to_sum = share * ((1 - y) - y * none / (1 - none))
        to_z = to_sum[document] / (1 + np.exp(-z)) / nd
        g, gb = np.bincount(f, to_z[s], 1 << BITS) + 1e-5 * w, to_z.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= 0.1 * (m / a) / (np.sqrt(v / c) + 1e-8)
        bias -= 0.05 * (mb / a) / (math.sqrt(vb / c) + 1e-8)
    return float(bias), w.astype(np.float32)


class Scorer:
    def __init__(self, bias: float, weights):
        self.bias, self.weights, self.memo = bias, weights, {}

    def weight(self, word: str) -> float:
        if len(self.memo) >= WORD_MEMO:
            self.memo.clear()
        got = self.memo[word] = float(sum(self.weights[i] for i in features(word)))
        return got

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences; spans and scores of the sentences at 0.5 or more, or of the
        highest one where only several together reach 0.5."""
        memo, weight = self.memo.get, self.weight
        total, top, spans = 0.0, None, []
        for a, b in sentences(text):
            z = self.bias
            for word in set(text[a:b].split()):
                x = memo(word)
                z += weight(word) if x is None else x
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z >= 0:
                spans.append((a, b, 1 / (1 + math.exp(-min(z, 30.0)))))
            elif top is None or z > top[2]:
                top = (a, b, z)
        p = -math.expm1(-total)
        if p >= 0.5 and not spans:
            spans.append((top[0], top[1], 1 / (1 + math.exp(-top[2]))))
        return p, spans


def score(text: Column, model, spark: SparkSession) -> Column:
    """struct<score, offending> of whole texts."""
    kind = "struct<score double, offending array<struct<start bigint, end bigint, score double>>>"
    if model is None:
        return F.struct(F.lit(0.0).alias("score"), F.array().cast(kind[kind.index("array"):-1]).alias("offending"))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def run(texts):
        import pyarrow as pa
        scorer = Scorer(*shared.value)
        rows = [scorer(t.as_py() or "") for t in texts]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        found = [[{"start": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()),
                                           pa.array(found, pa.list_(span))], ["score", "offending"])

    return run(text)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
          max_chars: int = MAX_CHARS):
    return fit(*training_sample(documents, labels, label, per_class, max_chars))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row of ``documents``."""
    s = score(F.col("text"), train(documents, labels), documents.sparkSession)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("r"))
    return rows.select("doc_id", "held_out", "r.score", (F.col("r.score") >= threshold).cast("int").alias("predicted"),
                       "r.offending")


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` scored below ``threshold``, with all their columns."""
    r = fresh(documents, "_toxicity")
    scored = documents.withColumn(r, score(F.col("text"), train(documents, labels), documents.sparkSession))
    return scored.where(F.col(f"{r}.score") < threshold).drop(r)


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
