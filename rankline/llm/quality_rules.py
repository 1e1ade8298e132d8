"""Line-first quality rules.

A text is cut at newlines and every line with a word is judged on its own:

* punctuation: it has a mark that ends sentences in some script (Unicode's Sentence_Terminal, and
  the ellipsis), and fewer than 30 % of its words hold a run of two or more marks or symbols;
* navigation: it is not a row of links, that is, of three or more separators that make up at
  least a fifth of its words;
* boilerplate: it has none of the phrases, which are a parameter by language.

Lines that fail are removed; a document that loses more than half of its word characters is
rejected, as is one that fails the base rules on its whole text (under 50 words, or more than
half of its words inside three-word windows that occur twice or more).

Plan: one row-local Arrow function over whole texts, no shuffle, memory of one batch.

Defined results: NULL and empty texts have zero counts, fail the base and keep no text; every
row, repeated ones included, is judged on its own; other columns are ignored by ``judge`` and
kept by ``clean``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, table
from rankline.llm.registry import register

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
RUN = "[!?#*$%&|<>=~]{2,}"
# Boilerplate by language, in lower case (the rule lowers A-Z only); a line is held against all of them.
PHRASES = {
    "en": ("all rights reserved", "click here", "cookie policy", "copyright", "enable javascript", "licensed under",
           "log in", "lorem ipsum", "privacy policy", "sign up", "subscribe to", "terms of use"),
    "de": ("alle rechte vorbehalten", "allgemeine nutzungsbedingungen", "cookie-richtlinie", "hier klicken", "jetzt anmelden"),
    "es": ("aviso legal", "haga clic", "iniciar sesión", "política de privacidad", "todos los derechos reservados"),
    "fr": ("cliquez ici", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "tous droits réservés"),
}

REPORT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "n_lines bigint, n_failed_lines bigint, lost_chars bigint, cleaned string")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first ones included."""
    import numpy as np
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, of, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[of] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:shift + len(again)] |= again
    return int(inside.sum())


def sentence_marks() -> str:
    """The characters that end sentences, in any script."""
    import regex
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return "".join(regex.findall(r"\p{Sentence_Terminal}", every)) + "…"


class _Rules:
    def __init__(self, phrases: dict[str, tuple[str, ...]] = PHRASES):
        import re
        self.run = re.compile(RUN).search
        self.mark = re.compile("[" + re.escape(sentence_marks()) + "]").search
        # matched without case, over ASCII letters only
        every = sorted({p for of in phrases.values() for p in of})
        self.phrase = re.compile("|".join(map(re.escape, every)) or "(?!)").search

    def fails(self, line: str) -> bool:
        """Whether a line with a word breaks a rule."""
        if not self.mark(line):
            return True
        separators = sum(map(line.count, SEPARATORS))
        if separators >= 3 and 5 * separators >= len(line.encode().split()):
            return True
        if self.run(line):
            words = line.encode().split()
            if 100 * sum(self.run(w.decode()) is not None for w in words) >= 30 * len(words):
                return True
        return self.phrase(line.encode().lower().decode()) is not None

    def judge(self, text: str, with_text: bool) -> tuple:
        words = text.encode().split()
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        seen, dup, lines, failed, lost, kept = set(), 0, 0, 0, 0, []
        for line in text.split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                lines += 1
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
                if self.fails(line):
                    failed += 1
                    lost += len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
                    continue
            kept.append(line)
        return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines, failed, lost,
                "\n".join(kept) if with_text else None)


def report(text: Column, with_text: bool = False, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """Struct of the counts of a whole text, and the text without the failed lines if asked for."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    @F.arrow_udf(f"struct<{REPORT}>")
    def run(texts):
        import pyarrow as pa
        rules = _Rules(phrases)
        rows = [rules.judge(t.as_py() or "", with_text) for t in texts]
        types = [pa.int64()] * (len(names) - 1) + [pa.string()]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run(text)


def verdict(r: str) -> tuple[Column, Column]:
    """(base_failed, kept) from the report column ``r``."""
    base = ((F.col(f"{r}.n_words") < MIN_WORDS)
            | (100 * F.col(f"{r}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{r}.n_words")))
    return base, ~base & (100 * F.col(f"{r}.lost_chars") <= MAX_LOST_PERCENT * F.col(f"{r}.word_chars"))


def judge(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row."""
    rows = docs.select("doc_id", report(F.col("text"), phrases=phrases).alias("r"))
    base, kept = verdict("r")
    return rows.select("doc_id", "r.*", base.alias("base_failed"), kept.alias("kept")).drop("cleaned")


def clean(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, ``text`` without the failed lines."""
    r = fresh(docs, "_report")
    rows = docs.withColumn(r, report(F.col("text"), True, phrases))
    return rows.where(verdict(r)[1]).withColumn("text", F.col(f"{r}.cleaned")).drop(r)


_PHRASE = "|".join(sorted({p.replace("'", "''") for of in PHRASES.values() for p in of}))
_MARKS = sentence_marks().replace(".", "").replace("?", "")  # both stand for themselves in the class
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT r, count(*) AS n_repeat_words
      FROM (SELECT DISTINCT r, i + s.k FROM h, (SELECT unnest([0, 1, 2]) AS k) s WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
             length(line) - length(regexp_replace(line, '[|»›•]', '', 'g')) AS sep FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT r, line, length(array_to_string(w, '')) AS chars,
             NOT regexp_matches(line, '[.?{_MARKS}]') OR (sep >= 3 AND 5 * sep >= len(w))
             OR (regexp_matches(line, '{RUN}') AND 100 * len(list_filter(w, lambda x: regexp_matches(x, '{RUN}'))) >= 30 * len(w))
             OR regexp_matches({_LOWER.format('line')}, '{_PHRASE}') AS failed FROM m),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0) AS lost_chars FROM n GROUP BY r),
y AS (SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
      FROM b LEFT JOIN p USING (r) LEFT JOIN x USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM y
"""


@register("op9_quality_rules", SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
