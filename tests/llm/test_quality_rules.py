import random
import re
from collections import Counter

import regex

from rankline.llm import quality_rules as qr

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    words = re.findall(W, t)
    count = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(W, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\nx\n x\nx ", "| a | b | c |\nplain text here.",
         "é ü   z\x1cq", "one two three four. " * 40, "no marks at all " * 30,
         "\n".join(f"Line{i} has word{i} and more{i} here{i}." for i in range(20)),
         "All rights reserved.\n" + "\n".join(f"Line{i} has word{i} and more{i} here{i}." for i in range(20)),
         "BUY!! NOW!! CHEAP!! " * 5 + "word " * 60, "w" * 100000 + " ."]


def test_counts_and_verdicts(spark, make_docs):
    docs = make_docs(list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, TEXTS[3])])
    rows = qr.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r.doc_id if r.doc_id is not None else 3]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and 2 * r.lost_chars <= r.word_chars)
    assert {r.doc_id for r in rows if r.kept} == {10, 11}
    assert qr.judge(make_docs([])).count() == 0


def test_clean_text(spark, make_docs):
    docs = make_docs([(i, TEXTS[i]) for i in (10, 11, 9)]).withColumn("_report", qr.F.lit(1))
    got = {r.doc_id: r.text for r in qr.clean(docs).collect()}
    assert got == {10: TEXTS[10], 11: TEXTS[11].replace("All rights reserved.\n", "")}
    assert qr.clean(docs).columns == docs.columns


def test_repeat_words_with_large_vocabulary():
    words = [str(i).encode() for i in range(1 << 20)] + [b"1", b"2", b"3"]
    assert qr.repeat_words(words) == 6


def brute_line_fails(line):
    """The line rules, one after another."""
    words = re.findall(W, line)
    if not any(regex.match(r"[\p{Sentence_Terminal}…]", c) for c in line):
        return True
    bars = sum(c in "|»›•" for c in line)
    if bars >= 3 and 5 * bars >= len(words):
        return True
    noisy = [w for w in words if re.search(r"[!?#*$%&|<>=~][!?#*$%&|<>=~]", w)]
    if noisy and 100 * len(noisy) >= 30 * len(words):
        return True
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return any(p in low for of in qr.PHRASES.values() for p in of)


def test_verdicts_equal_brute_force(spark, make_docs):
    rnd = random.Random(7)
    pool = ["A plain line number %d ends here.", "no mark in this line %d", "Home | News | More | %d.", "wow!! buy%%%% now## %d.",
            "Copyright %d by someone.", "これは文です%d。", "यह वाक्य है %d।", "Tous droits réservés %d.", "Alle Rechte vorbehalten %d!", "", " \t"]
    def line():
        p = pool[0] if rnd.random() < share else rnd.choice(pool)
        # a number behind every second word, so that windows hardly repeat
        return " ".join(w if rnd.random() < .5 else w + str(rnd.randint(0, 10**6)) for w in p.replace("%d", "7").replace("%%", "%").split())

    docs = []
    for i in range(60):
        share = (i % 6) / 5
        docs.append((i, "\n".join(line() for _ in range(rnd.randint(0, 30)))))
    wide = make_docs(docs).withColumn("N_WORDS", qr.F.lit(1)).withColumn("kept", qr.F.lit(2)).withColumn("r", qr.F.lit(3))
    got = {r.doc_id: r for r in qr.judge(wide).collect()}
    for i, text in docs:
        lines = [x for x in text.split("\n") if re.search(W, x)]
        lost = sum(len("".join(re.findall(W, x))) for x in lines if brute_line_fails(x))
        n, chars, _, _, repeats = brute(text)
        base = n < 50 or 100 * repeats > 50 * n
        r = got[i]
        assert (r.n_lines, r.n_failed_lines, r.lost_chars) == (len(lines), sum(map(brute_line_fails, lines)), lost)
        assert (r.base_failed, r.kept) == (base, not base and 2 * lost <= chars)
    assert any(r.kept for r in got.values()) and any(not r.kept and not r.base_failed for r in got.values())


def test_texts_of_other_scripts_are_kept(spark, make_docs):
    # words of their own in every line, so that no window repeats
    for mark in "。।．؟":
        text = "\n".join(" ".join(f"字{i}語{k}" for k in range(6)) + mark for i in range(20))
        assert qr.judge(make_docs([(1, text)])).first().kept, mark


def test_phrases_are_a_parameter(spark, make_docs):
    text = "\n".join(f"Line{i} has word{i} of the house{i}." for i in range(30))
    assert qr.judge(make_docs([(1, text)])).first().n_failed_lines == 0
    assert qr.judge(make_docs([(1, text)]), {"en": ("of the house1",)}).first().n_failed_lines == 11
    assert qr.judge(make_docs([(1, "Copyright me. " * 30)]), {}).first().n_failed_lines == 0
