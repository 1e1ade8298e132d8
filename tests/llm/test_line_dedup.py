import random
import re

import pytest

from rankline.llm import line_dedup

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def brute(docs, min_words):
    """All runs of lines with enough words; the lines of those that are not the first copy and do not overlap it go."""
    seen, keys = [], {}
    for i, (doc, text) in enumerate(docs):
        keys.setdefault((doc, text), []).append(i)
    order = sorted(keys, key=lambda k: (k[0] is None, k[0] or 0, SIGN[k[1] or ""]))
    seqs = []
    for key in order:
        parts = (key[1] or "").split("\n")
        seqs.append((key, [p.strip(SPACE) for p in parts]))
    flat, at = [], {}
    for n, (key, parts) in enumerate(seqs):
        at[n] = len(flat)
        flat += parts + [("end", n)]
    # earliest place of every run of lines with enough words
    runs, earliest, where = [], {}, {}
    for n, (key, parts) in enumerate(seqs):
        for i in range(len(parts)):
            where[at[n] + i] = n
            words = 0
            for k in range(1, len(parts) - i + 1):
                if not parts[i + k - 1]:
                    break
                words += len(re.findall(r"[^\x20\x09-\x0D]+", parts[i + k - 1]))
                if words >= min_words:
                    run = tuple(parts[i:i + k])
                    runs.append((key, n, i, k, earliest.setdefault(run, at[n] + i)))
    drop = {key: set() for key, _ in seqs}
    for key, n, i, k, first in runs:
        # a copy in the same document is a later one from the end of the one that stays on
        if first != at[n] + i and (where[first] != n or at[n] + i >= first + k):
            drop[key] |= set(range(i, i + k))
    out = []
    for doc, text in docs:
        gone = drop[(doc, text)]
        parts = (text or "").split("\n")
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(parts) if i not in gone)))
    return sorted(out, key=str)


SIGN = {}


def check(spark, make_docs, docs, min_words):
    from pyspark.sql import functions as F
    df = make_docs(docs)
    for r in df.select("text", line_dedup._text_key(F.col("text")).alias("t")).collect():
        SIGN[r.text or ""] = r.t
    out = line_dedup.dedup_lines(df, min_words)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(docs, min_words)


@pytest.mark.parametrize("min_words", [1, 3, 9])
def test_random_documents(spark, make_docs, min_words):
    rnd = random.Random(min_words)
    pool = ["a", "b b", "c c c", "d", " e e ", "", "f f f f"]
    docs = [(i, "\n".join(rnd.choice(pool) + (f" {rnd.randint(0, 9)}" if rnd.random() < .2 else "")
                          for _ in range(rnd.randint(0, 14)))) for i in range(25)]
    check(spark, make_docs, docs, min_words)


def test_edges(spark, make_docs):
    run = "\n".join(f"line {i} of the run" for i in range(40))
    docs = [(3, run), (1, "x y\n" + run + "\nz"), (2, None), (4, ""), (5, run), (5, run), (6, run + "\nmore"), (None, run),
            (7, "a b c\n" * 30), (8, "\n\n \n"), (9, "head\n" + run[:200])]
    check(spark, make_docs, docs, 50)
    check(spark, make_docs, [(8, "a b c\n" * 5)], 6)
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
    clash = make_docs(docs[:2]).toDF("doc_id", "text", "copies", "_cut", "pos")
    assert line_dedup.dedup_lines(clash).columns == clash.columns


def test_whole_table(spark, make_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [d for d in docs if d[1].count("\n") < 25][:120]
    check(spark, make_docs, short, 50)
    check(spark, make_docs, short, 5)
    got = line_dedup.op5_line_dedup(spark, SF)
    assert got.count() == len(docs) and got.where("n_removed > 0").count() > 0


def test_first_copy_stays_whole_where_copies_overlap(spark, make_docs):
    line = " ".join(f"w{i}" for i in range(25))
    out = line_dedup.dedup_lines(make_docs([(1, "\n".join([line] * 4)), (2, "\n".join([line] * 3 + ["end"]))])).collect()
    assert {r.doc_id: r.text for r in out} == {1: "\n".join([line] * 2), 2: "end"}


def test_maximal_runs_and_their_first_copies(spark, make_docs, tmp_path):
    run = [f"line {i} of a run that repeats" for i in range(30)]
    docs = [(1, "\n".join(["a", *run])), (2, "\n".join([*run, "b", "c", *run[5:25], "d"])), (3, "\n".join(run[:12]))]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got[1].runs is None and got[1].n_removed == 0
    assert [tuple(x) for x in got[2].runs] == [(0, 30, 1, 1), (32, 20, 1, 6)] and got[2].text == "b\nc\nd"
    assert [tuple(x) for x in got[3].runs] == [(0, 12, 1, 1)] and got[3].text == ""


def squeezed(docs):
    """The texts without their blank lines."""
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(SPACE))) for d, t in docs]


def check_across(spark, make_docs, docs, min_words):
    """The lines with a word that stay are those of the brute force on texts without blank lines; all blank lines stay."""
    from pyspark.sql import functions as F
    for r in make_docs(docs).select("text", line_dedup._text_key(F.col("text")).alias("t")).collect():
        SIGN[r.text or ""] = r.t
    short = squeezed(docs)
    SIGN.update({s[1] or "": SIGN[d[1] or ""] for d, s in zip(docs, short)})  # the order is that of the whole texts
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(make_docs(docs), min_words, across_blank=True).collect()]
    assert sorted(squeezed(got), key=str) == sorted(squeezed(brute(short, min_words)), key=str)

    def blank(rows):
        return sorted(((d, sum(not x.strip(SPACE) for x in (t or "").split("\n"))) for d, t in rows if t and t.strip(SPACE)), key=str)

    texts = dict(docs)
    assert blank(got) == blank([(d, texts[d]) for d, t in got if t and t.strip(SPACE)])


@pytest.mark.parametrize("min_words", [3, 9])
def test_random_documents_across_blank_lines(spark, make_docs, min_words):
    rnd = random.Random(min_words)
    pool = ["a", "b b", "c c c", "d", " e e ", "", "", " \t", "f f f f"]
    docs = [(i, f"doc{i} head\n" + "\n".join(rnd.choice(pool) + (f" {rnd.randint(0, 9)}" if rnd.random() < .2 else "")
                                              for _ in range(rnd.randint(0, 14)))) for i in range(25)]
    check_across(spark, make_docs, docs, min_words)


def test_passage_of_short_paragraphs(spark, make_docs, tmp_path):
    paragraphs = [" ".join(f"w{p}x{i}" for i in range(30)) for p in range(2)]
    passage = "\n\n".join(paragraphs)
    docs = [(1, passage), (2, "head\n" + passage + "\ntail"), (3, paragraphs[0] + "\n\nother"), (4, passage.replace("\n\n", "\n \n\n"))]
    check_across(spark, make_docs, docs, 50)
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed, r.removed, r.first_copies) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (passage, 0, None, None), 2: ("head\n\ntail", 2, [[1, 2], [3, 4]], [1]),
                   3: (docs[2][1], 0, None, None), 4: (" \n", 2, [[0, 1], [3, 4]], [1])}
