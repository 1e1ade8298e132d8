from collections import Counter

import pytest

from rankline.llm import mixing


def brute_targets(sizes, share=1.5, cap=2.0, weights=mixing.WEIGHTS):
    """Share out by weight; cut at the caps and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: left * w[s] / total for s in free}}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def rows_of(spec):
    return [(i, " ".join(["w"] * n) if n is not None else None, s) for i, (n, s) in enumerate(spec)]


SPEC = ([(40, "a")] * 300 + [(i % 90, "b") for i in range(200)] + [(7, None)] * 50 + [(None, "c"), (0, "c"), (3, "d"), (500, "z")])


def test_targets_and_taken(spark, make_docs):
    got = mixing.plan_mix(make_docs(rows_of(SPEC))).collect()
    sizes = Counter()
    for n, s in SPEC:
        sizes[s] += n or 0
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(got) == len(SPEC)
    for s in sizes:  # within the largest document of the source
        assert abs(taken[s] - want[s]) <= max(n or 0 for n, x in SPEC if x == s) + 1e-6
    again = mixing.plan_mix(make_docs(rows_of(SPEC)).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_emits_the_planned_copies(spark, make_docs):
    docs = make_docs(rows_of(SPEC))
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in plan.items() if c})


def test_edge_tables(spark, make_docs):
    assert mixing.plan_mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([])).count() == 0
    got = mixing.plan_mix(make_docs([(1, None, "a"), (None, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
    same = mixing.plan_mix(make_docs([(5, "x y", "a")] * 4 + [(None, "x", "a")])).collect()
    assert sum(r.taken for r in same) in (12, 13, 14, 15) and len(same) == 5
    clash = make_docs([(1, "a b", "s")]).withColumn("size", mixing.F.lit("x")).withColumn("target", mixing.F.lit(1))
    assert mixing.plan_mix(clash).first()["size"] == 2 and mixing.mix(clash).columns == clash.columns


def test_the_number_of_buckets_changes_no_result(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "two words" if i % 3 else None, f"s{i % 2}") for i in range(300)])
    want = sorted((r.doc_id, r.copies) for r in mixing.plan_mix(docs).collect())
    assert mixing._digits(docs) == 2
    monkeypatch.setattr(mixing, "_digits", lambda d: 4)
    assert sorted((r.doc_id, r.copies) for r in mixing.plan_mix(docs).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert mixing._digits(docs) == 3
