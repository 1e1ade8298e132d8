import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from rankline.llm import fill_middle as fm

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
PASSAGE = "The quick Ünï fox; 漢字 jumps over 12 lazy dogs' tails.\n" * 40


def brute(doc_id, text):
    x = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(x)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not x or any(k in x for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, x
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(3)
    out = [None, "", " ", "a", "é", "<P>", "x <S", "ab<M>c", "<<S>", "a" * 10_000, " " * 10_000, "漢" * 5000, "a1" * 4000,
           "\x00\r\n\t", "é😀" * 900, PASSAGE, PASSAGE, "x" + PASSAGE, PASSAGE * 30, "<" * 500, "S><P" * 200]
    for alphabet in ("ab ", "aZ é\n", "漢字 a", "<PSM>"):
        out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4000))) for _ in range(25)]
    out += [PASSAGE[rnd.randint(0, 500):rnd.randint(600, 1500)] * rnd.randint(1, 4) for _ in range(30)]
    return out


def run(docs):
    got = fm.fill_in_middle(docs)
    return got.withColumn("back", fm.restore(F.col("output"), F.col("form")))


def test_equals_brute_force_and_restores(spark, make_docs):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())]
    got = run(make_docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == \
        sorted((brute(*r) for r in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((*brute(d.doc_id, d.text)[:5], sha(brute(d.doc_id, d.text)[5]), sha(d.text or "")) for d in docs)
    assert sorted(tuple(r) for r in fm.op11_fill_middle(spark, SF).collect()) == want


def test_rows_columns_and_empty_table(spark, make_docs):
    rows = [(7, "same text here")] * 3
    wide = make_docs(rows).withColumn("N", F.lit("old")).withColumn("_cut", F.lit(5)).withColumn("_form", F.lit(6))
    got = fm.fill_in_middle(wide)
    assert got.count() == 3 and got.distinct().count() == 1
    r = got.first()
    assert r.n == 5 and r["_cut"] == 5 and r["_form"] == 6 and "N" not in got.columns
    assert fm.fill_in_middle(make_docs([])).count() == 0


def test_chunks_depend_on_content_only():
    gear, _ = fm._tables()
    rnd = random.Random(1)
    body = bytes(rnd.randrange(256) for _ in range(30_000))
    cut = lambda x: [x[a:b] for ends in fm.boundaries(np.frombuffer(x, np.uint8), [0, len(x)], gear)
                     for a, b in zip([0, *ends], ends)]
    plain, moved = cut(body), cut(b"some other beginning, " * 9 + body)
    assert b"".join(moved).endswith(body) and b"".join(plain) == body
    assert len(set(plain) & set(moved)) > 0.9 * len(plain)
    assert all(fm.LEAST <= len(x) <= fm.MOST for x in plain[:-1])
    # a text's chunks do not depend on the texts in front of it in the batch
    both = fm.boundaries(np.frombuffer(b"abc" * 50 + body, np.uint8), [0, 150, 150 + len(body)], gear)
    assert [e - 150 for e in both[1]] == np.cumsum([len(x) for x in plain]).tolist()


def test_equal_chunks_are_counted_once_and_the_memo_is_bounded(monkeypatch):
    _, kind = fm._tables()
    memo = fm.ChunkMemo(kind)
    assert memo(b"ab cd") == (3, 5, True, True) and memo("é1".encode()) == (2, 2, False, False)
    calls = []
    monkeypatch.setattr(memo, "starts_of", lambda *a: calls.append(a) or fm.ChunkMemo.starts_of(memo, *a))
    assert memo(b"ab cd") == (3, 5, True, True) and not calls
    monkeypatch.setattr(fm, "MEMO_BYTES", 300)
    for i in range(20):
        memo(b"%d x" % i)
    assert memo.bytes <= 300 + 250 and len(memo.known) <= 3


def test_texts_longer_than_a_slab(spark, make_docs, monkeypatch):
    monkeypatch.setattr(fm, "SLAB", 1000)
    rows = [(i, t) for i, t in enumerate(texts()[:40])]
    got = fm.fill_in_middle(make_docs(rows)).collect()
    assert {r.doc_id: (r.n, r.output) for r in got} == {i: (brute(i, t)[1], brute(i, t)[5]) for i, t in rows}


def test_oracle_of_plain_share(spark):
    forms = {r.form: r["count"] for r in fm.op11_fill_middle(spark, "/root/testdata/sf0.01").groupBy("form").count().collect()}
    n = sum(forms.values())
    assert 0.05 < forms["plain"] / n < 0.2 and 0.1 < forms["spm"] / (n - forms["plain"]) < 0.3
