import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankline.llm import word_langid as wl

SF = "/root/testdata/sf0.1"
TRAIN = [("a", "the cat sat on the mat. The dog!"), ("a", "a cat and a dog and THE end"), ("b", "le chat est sur le tapis"),
         ("b", "le chien et la fin du chat"), ("c", "die Katze saß auf der Matte, größer"), ("c", None), (None, "le the die"),
         ("b", ""), ("a", "123 456"), ("c", "漢字かな"), ("a", "x" * 300)]
TEXTS = ["the cat", "le chat", "die Katze", "cats", "chats tapi", "größte Maße", "漢", "THE le le", "12 !!", "", None, " \n",
         "ж", "the ж 漢字", "x" * 200, "le " * 5000 + "the", "dog chien"]


def split(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def model(rows, grams=wl.GRAMS):
    """Words and n-grams with their costs, by plain counting."""
    word, gram = {}, {}
    for lang, text in rows:
        if lang is not None:
            word.setdefault(lang, Counter()).update(split(text))
    for lang, c in word.items():
        for w, n in c.items():
            w = f" {w} "
            for size in range(1, grams + 1):
                for i in range(len(w) - size + 1):
                    if w[i:i + size] != " ":
                        gram.setdefault((lang, size), Counter())[w[i:i + size]] += n
    cost = lambda c: {k: math.log(sum(c.values()) / n) for k, n in c.items()}
    words = {x: {k: v for k, v in cost(Counter(
        {w: n for w, n in c.items() if len(w) <= wl.WORD_CHARS})).items()} for x, c in word.items()}
    return words, {k: cost(c) for k, c in gram.items()}


def brute(text, words, pieces, languages, grams=wl.GRAMS):
    found = split(text)
    if not found or not languages:
        return "und", 0.0
    total = dict.fromkeys(languages, 0.0)
    for w in found:
        if any(w in words.get(x, {}) for x in languages):
            for x in languages:
                total[x] += words.get(x, {}).get(w, wl.PENALTY)
            continue
        padded = f" {w} "
        for size in range(grams, 0, -1):
            parts = [padded[i:i + size] for i in range(len(padded) - size + 1)]
            parts = [g for g in parts if any(g in pieces.get((x, size), {}) for x in languages)]
            if parts:
                for x in languages:
                    total[x] += sum(pieces.get((x, size), {}).get(g, wl.PENALTY) for g in parts) / len(parts)
                break
    low = min(total.values())
    best = min(x for x in languages if total[x] <= low + 1e-9)
    return best, 1 / sum(math.exp(max(low - v, -700)) for v in total.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_scores_equal_brute_force(spark, monkeypatch):
    learnt = wl.train(frame(spark, TRAIN))
    words, grams = model(TRAIN)
    assert learnt.languages == ["a", "b", "c"]
    assert len(learnt.words.gain) == sum(map(len, words.values()))
    assert sum(len(e.gain) for e in learnt.grams.values()) == sum(map(len, grams.values()))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = wl.identify(texts, learnt).orderBy("i").collect()
    for r, t in zip(got, TEXTS):
        lang, score = brute(t, words, grams, learnt.languages)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=0.02)), t
    # texts cut into several slabs, between words only, get the same scores
    monkeypatch.setattr(wl, "SLAB", 7)
    assert learnt(TEXTS) == ([r.lang_pred for r in got], [r.score for r in got])


def test_model_is_bounded_by_its_parameters(spark):
    rows = frame(spark, [("a", " ".join(f"{c}{d}" for c in "abcdefghij" for d in "klmnopqrst") + " the" * 50), ("b", "the le le")])
    m = wl.train(rows, word_entries=40, gram_entries=100)
    assert 0 < len(m.words.gain) <= 40 and 0 < sum(len(e.gain) for e in m.grams.values()) <= 100
    chars = wl.Characters(" the le ")
    assert m.words.find(chars.hashes(chars.starts, chars.ends))[0].all()  # the most frequent stay


def test_hashes_depend_on_content_only():
    a, b = wl.Characters(" ab cd ab "), wl.Characters(" x \U0001f600 y ab cdé ")
    ha, hb = a.hashes(a.starts, a.ends).tolist(), b.hashes(b.starts, b.ends).tolist()
    assert ha[0] == ha[2] == hb[2] and len({*ha, *hb}) == 5
    place, key = a.grams(np.arange(3), 3)
    assert place.tolist() == [0, 0, 1, 1, 2, 2] and key[0] == key[4] and key[1] == key[5] and key[0] != key[1]


def test_ties_empty_tables_and_other_columns(spark, make_docs):
    same = wl.train(frame(spark, [("z", "one two"), ("y", "one two")]))
    df = spark.createDataFrame([("one", "old", 1), ("three", "old", 2), (None, "old", 3)], "text string, LANG_PRED string, _identified int")
    got = {r["_identified"]: (r.lang_pred, r.score) for r in wl.identify(df, same).collect()}
    assert got[1] == ("y", 0.5) and got[3] == ("und", 0.0) and got[2][0] == "y"
    none = wl.train(frame(spark, []))
    assert [r.lang_pred for r in wl.identify(df, none).collect()] == ["und"] * 3
    assert wl.identify_documents(make_docs([])).count() == 0
    docs = make_docs([(1, "same text"), (1, "same text"), (None, "same text"), (2, None)])
    got = wl.identify_documents(docs).collect()
    assert len(got) == 4 and {r.held_out for r in got if r.doc_id is None} == {True}


def test_neither_source_nor_held_out_languages_are_learnt(spark, make_docs):
    docs = make_docs([(i, f"word{'abcdefghij'[i % 10]} text") for i in range(50)])
    held = wl.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    key = lambda df: sorted(tuple(r) for r in wl.identify_documents(df).collect())
    assert key(other) == key(docs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isNotNull())
    got = wl.op13_word_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert r[0] > 0.98 and r[1] > 1000
