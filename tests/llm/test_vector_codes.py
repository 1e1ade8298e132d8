import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankline.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python: {row number: (code, error)} and the digest of the codebooks."""
    kept = {i: [math.floor(4096 * x) for x in v] for i, (_, v, _) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    order = sorted(kept, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, kept[i]))
    cut = {i: [v[p * width:(p + 1) * width] for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for i in kept:
                groups.setdefault(near(cut[i][p], books[p])[1], []).append(cut[i][p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else c
                        for e, c in enumerate(books[p])]
    out = {}
    for i in kept:
        got = [near(cut[i][p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return out, digest


def compressed(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + SCHEMA)
    coded, books = vc.compress(df, **options)
    return {r.n: (r.code, r.error) for r in coded.collect()}, vc.codebooks_digest(books)


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    by_label = {}
    for i, (_, error) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + error
    got = vc.op12_vector_codes(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted((rows[i][0], c, e, by_label[rows[i][2]], digest) for i, (c, e) in want.items())


def test_ties_repeats_nulls_and_few_vectors(spark):
    rnd = random.Random(4)
    # few distinct components: many equal distances and equal entries
    rows = [(rnd.randint(0, 60) or None, [rnd.choice((0.0, 0.5, -0.25)) for _ in range(16)], rnd.choice((1, 2, None)))
            for _ in range(150)]
    odd = [(0, None, 1), (1, [None] + [0.0] * 15, 1), (2, [math.nan] + [0.0] * 15, 1), (3, [math.inf] + [0.0] * 15, 1)]
    assert compressed(spark, rows + odd) == brute(rows + odd)
    assert compressed(spark, rows[:5] + odd) == brute(rows[:5] + odd)   # fewer vectors than entries
    assert compressed(spark, rows[:1] * 40) == brute(rows[:1] * 40)     # copies only
    assert compressed(spark, odd) == ({}, hashlib.sha256(b"").hexdigest())
    assert compressed(spark, []) == ({}, hashlib.sha256(b"").hexdigest())


def test_other_dimensions_and_large_components(spark):
    rows = [(i, [float(i), -float(i)] * 8, 1) for i in range(30)]
    want, digest = brute(rows)
    got = compressed(spark, rows + [(50, [1.0] * 8, 1), (51, [], 1), (52, [1e30] * 16, 1)])
    assert got == ({**want, 30: (None, None), 31: (None, None), 32: (None, None)}, digest)
    with pytest.raises(ValueError):
        compressed(spark, [(1, [1.0] * 7, 1)])


def test_clashing_columns_and_label_totals(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8, None if i % 2 else 3, "x", 5) for i in range(40)],
                               SCHEMA + ", CODE string, _coded int")
    coded, _ = vc.compress(df)
    assert sorted(c.lower() for c in coded.columns) == ["_coded", "code", "embedding", "error", "label", "vec_id"]
    r = vc.with_label_error(coded).collect()
    total = {k: sum(x.error for x in r if x.label == k) for k in (None, 3)}
    assert len(r) == 40 and all(x.label_error == total[x.label] and x["_coded"] == 5 for x in r)


@pytest.mark.parametrize("entries", [1, 2, 4, 5, 16, 100])
def test_tree_equals_scan_and_leaves_subtrees_out(entries):
    rng = np.random.default_rng(entries)
    centres = rng.integers(-4000, 4000, (8, 6))
    points = centres[rng.integers(0, 8, entries)] + rng.integers(-40, 40, (entries, 6))
    queries = np.concatenate([centres[rng.integers(0, 8, 600)] + rng.integers(-60, 60, (600, 6)), points])
    d = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    counted = np.zeros(len(queries), int)
    index, best = vc.Gnat(points).nearest(queries, counted)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    if entries == 100:
        assert counted.mean() < 0.6 * entries


def test_tree_settles_exact_ties():
    rng = np.random.default_rng(9)
    for _ in range(30):
        points, queries = rng.integers(-2, 3, (24, 2)), rng.integers(-3, 4, (200, 2))
        d = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
        index, best = vc.Gnat(points).nearest(queries)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_whole_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 10**15, 2**52 - 1, 2**60, 2**60 - 1, (2**30 + 1)**2 - 1])
    assert vc.floor_root(x).tolist() == [math.isqrt(v) for v in x.tolist()]
    assert vc.ceil_root(x).tolist() == [math.isqrt(v - 1) + 1 if v else 0 for v in x.tolist()]
