import math
import re
from collections import Counter

import pytest

from rankline.llm import lm_score

SF = "/root/testdata/sf0.001"


def brute(docs, order=3, alpha=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]

    def grams(w):
        return Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum((grams(w) for w in words), Counter())
    total = sum(map(len, words))
    out = []
    for (doc, _), w in zip(docs, words):
        own = grams(w)
        rest, score, level = max(1, total - len(w)), 0.0, Counter()
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, -1, -1):
                if n == 0:
                    s = math.log(alpha) - math.log(rest) + (top - 1) * math.log(alpha)
                    break
                g = tuple(w[i - n + 1:i + 1])
                c = every[g] - own[g]
                if c > 0:
                    under = every[g[:-1]] - own[g[:-1]] if n > 1 else rest
                    s = math.log(c / under) + (top - n) * math.log(alpha)
                    break
            score += s
            level[n] += 1
        out.append((doc, len(w), round(score, 5), [level[n] for n in range(1, order + 1)], level[0]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, round(r.log_score, 5), r.n_by_order, r.n_unseen) for r in df.collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_edges(spark, make_docs, order):
    docs = [(1, "a b a b c"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "a b x y z"), (5, "Ü ü\n漢"),
            (6, "w " * 3000)] + [(10 + i, "the same text again") for i in range(20)]
    for size in (64, 1 << 20):
        assert got(lm_score.score_documents(make_docs(docs), order, chunk_bytes=size)) == brute(docs, order)
    assert lm_score.score_documents(make_docs([])).count() == 0
    assert got(lm_score.score_documents(make_docs([(1, "only one here")]))) == brute([(1, "only one here")])
    assert got(lm_score.score_documents(make_docs([(1, None)]))) == [(1, 0, 0.0, [0, 0, 0], 0)]


def test_whole_table_with_many_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(lm_score.score_documents(docs, chunk_bytes=1 << 17, bucket_bytes=1 << 10)) == brute(rows)
