import random
import re

import xxhash

from rankline.llm import simhash
from rankline.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    parts = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, d):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= d:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(pairs):
    by = {}
    for node, root in pairs:
        by.setdefault(root, set()).add(node)
    return {frozenset(v) for v in by.values()}


def expect(docs):
    fp = [(i, brute_fp(t)) for i, t in docs]
    root = brute_components([f for _, f in fp], 2)
    low = {}
    for i, f in fp:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    return sorted(((i, f"{f:016x}", low.get(root[f])) for i, f in fp), key=str)


def test_whole_table_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash.op4_simhash_near_dedup(spark, SF).collect()), key=str)
    assert got == expect(docs)


def test_edge_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b"), (6, "a b"),
            (7, "x " * 30000), (8, "Ünï  x y"), (None, None), (9, "zz")]
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id)
                  for r in simhash.components_of(make_docs(rows)).collect()), key=str)
    assert got == expect(rows)
    assert simhash.components_of(make_docs([])).count() == 0
    kept = simhash.keep_representatives(make_docs(rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 6, 7, 8, 9]


def test_links_of_random_crowds(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            f = base
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                f ^= 1 << b
            fps.add(f)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for d in (1, 2):
        want = groups((signed(f), r) for f, r in brute_components(fps, d).items())
        want = {g for g in want if len(g) > 1}
        for crowded in (2, 4, 1000):
            e = simhash.links(df, d, crowded)
            for r in e.collect():
                assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= d
            c = [(r.node, r.root) for r in components(e, "a", "b").collect()]
            got = groups(c + [(r, r) for _, r in c])
            assert got == want, (d, crowded)


def test_components_on_long_path(spark):
    n = 200
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = dict((r.node, r.root) for r in components(path, "a", "b").collect())
    assert got == {**{i: 0 for i in range(1, n + 1)}, 501: 500}
