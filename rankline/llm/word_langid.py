"""Language ID by words first, with back-off to character n-grams.

A word is a maximal run of letters, in lower case.  Every language has the negative logarithm of the
relative frequency of each word it knows.  A word that some language knows is scored by that: a
language that does not know it pays ``PENALTY``, the most that any entry costs.  A word that no
language knows is scored by the longest character n-grams that any language knows: those of
``GRAMS`` characters, else one fewer, and so on down to single characters; the word's score is the mean
over the n-grams that occur in it and are known.  A word without even one known character says
nothing.  The document's language has the smallest sum of scores over its words (ties: the smaller
name); the softmax of the sums gives ``score``.

The n-grams of a word are taken with a blank before and behind it, and counted as often as the word.
Scores of words are whole multiples of 2^-20, so sums do not depend on their order.

Plan: words of all labelled rows are counted, map-side per Arrow batch and then by one grouped sum;
n-grams are counted from the table of distinct words.  Of the counts, the entries of the highest relative
frequency stay, at most ``WORD_ENTRIES`` words of up to ``WORD_CHARS`` letters and ``GRAM_ENTRIES`` n-grams over all
languages together: the size of the model, whatever the corpus.  The cut is found from counts of frequency
levels, without a sort.  The model is broadcast; all texts are scored whole by a row-local Arrow
function, without a shuffle.  Tasks work on arrays of characters, ``SLAB`` at a time: words and n-grams are told
apart by 64-bit sums of character values times powers, taken from one running sum, and each distinct word of
a slab is scored once.

Defined results: a NULL text and a text without a letter are ``und`` with score 0.  Without any row to
learn from every text is ``und``; with letters but no known word or character, the languages tie.  Rows
with a NULL id are held out.  Repeated rows count as often as they occur and are each scored.
Other columns pass through ``identify`` (those with the names of the new ones are replaced).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, held_out, table
from rankline.llm.registry import register
from rankline.session import cut_lineage

UNKNOWN = "und"
GRAMS = 6
WORD_ENTRIES = 200_000
GRAM_ENTRIES = 200_000
# Natural logarithm; what a language pays for a word or n-gram that it does not know.
PENALTY = 16.0
# Longer words are scored by their n-grams only.
WORD_CHARS = 64
# Characters that a task works on at a time (a bound on memory only; one longer word is taken whole).
SLAB = 2_000_000
UNIT = 1 << 20
BLANK = 32
NO_LETTER = re.compile(r"[\W\d_]")

# Per worker: letter or not and a 64-bit value by character, powers of an odd number and of its inverse.
_TABLES: dict = {}


def _alphabet():
    import numpy as np
    if "mix" not in _TABLES:
        _TABLES["letter"] = np.array([chr(c).isalpha() for c in range(0x110000)])
        _TABLES["mix"] = np.random.default_rng(13).integers(0, 1 << 64, 0x110000, np.uint64, endpoint=False)
    return _TABLES["letter"], _TABLES["mix"]


def _powers(n: int):
    import numpy as np
    base = 0x9E3779B97F4A7C15
    for name, x in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
        if len(_TABLES.get(name, ())) < n:
            steps = np.full(max(n, SLAB + 4096), x, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["powers"], _TABLES["inverse"]


class Characters:
    """A string that begins and ends with a blank, as an array: where its words are, and their hashes."""

    def __init__(self, text: str):
        import numpy as np
        letter, mix = _alphabet()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter[codes]
        powers, self.inverse = _powers(len(codes))
        values = mix[np.where(inside, codes, BLANK)] * powers[:len(codes)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1

    def hashes(self, a, b):
        """Hashes of the strings [a, b)."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def grams(self, word, size: int):
        """(place in ``word``, hash) of the n-grams of one size of the words of these numbers, blanks at both ends included."""
        import numpy as np
        a, b = self.starts[word] - 1, self.ends[word] + 1
        many = np.maximum(b - a - size + 1, 0)
        place = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + a[place]
        return place, self.hashes(at, at + size)


def slabs(texts):
    """(row numbers, offsets, string) of pieces of texts in lower case, about ``SLAB`` characters each; a text is
    cut between words only."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        low, at = (text or "").lower(), 0
        while at < len(low):
            end = len(low)
            if end - at > SLAB and (m := NO_LETTER.search(low, at + SLAB)):
                end = m.end()
            if parts and size + end - at > SLAB:
                yield _slab(rows, parts)
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(low[at:end])
            size += end - at
            at = end
    if parts:
        yield _slab(rows, parts)


def _slab(rows, parts):
    import numpy as np
    return np.array(rows), np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1], " " + " ".join(parts) + " "


def words_of(rows, offsets, text: str):
    """(Characters, row number of each word)."""
    import numpy as np
    chars = Characters(text)
    return chars, rows[np.searchsorted(offsets, chars.starts, "right") - 1]


def _count_words(batches):
    """(lang, word, n) of Arrow batches of (lang, text): one row per word and language of a slab."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        code = lang.indices.to_numpy(zero_copy_only=False)
        for rows, offsets, text in slabs(t.as_py() for t in batch.column(1)):
            chars, row = words_of(rows, offsets, text)
            key, of = chars.hashes(chars.starts, chars.ends), code[row]
            for k in np.unique(of):
                at = np.flatnonzero(of == k)
                _, first, n = np.unique(key[at], return_index=True, return_counts=True)
                a, b = chars.starts[at[first]].tolist(), chars.ends[at[first]].tolist()
                word = [text[i:j] for i, j in zip(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([lang.dictionary[k].as_py()] * len(word), pa.string()),
                                                  pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _count_grams(grams: int):
    """(lang, size, key, n) of Arrow batches of (lang, word, n): hashes of the words' n-grams."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def count(tables):
            """One batch of rows per size for words that were gathered."""
            t = pa.Table.from_batches(tables)
            lang = t.column(0).combine_chunks().dictionary_encode()
            code, n = lang.indices.to_numpy(zero_copy_only=False).astype(np.uint64), t.column(2).to_numpy()
            chars = Characters(" " + " ".join(t.column(1).to_pylist()) + " ")
            every = np.arange(len(n))
            blank = Characters("  ").hashes(np.array([0]), np.array([1]))[0]
            for size in range(1, grams + 1):
                place, key = chars.grams(every, size)
                if size == 1:
                    place, key = place[key != blank], key[key != blank]
                order = np.lexsort((key, code[place]))
                place, key = place[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (code[place[1:]] != code[place[:-1]])])) if len(key) else []
                if not len(new):
                    continue
                total = np.add.reduceat(n[place], new)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(code[place[new]].astype(np.int64))), pa.array(np.full(len(new), size, np.int32)),
                     pa.array(key[new].view(np.int64)), pa.array(total)], ["lang", "size", "key", "n"])

        gathered, size = [], 0
        for batch in batches:
            gathered.append(batch)
            size += batch.column(1).nbytes
            if size > SLAB:
                yield from count(gathered)
                gathered, size = [], 0
        if size:
            yield from count(gathered)
    return run


def _most_frequent(counts: DataFrame, entries: int) -> DataFrame:
    """(lang, size, key, cost) of at most ``entries`` rows of ``counts`` (lang, size, key, n): those of the
    highest relative frequency, whatever the language.

    Relative frequencies add up to one over a language's keys of one size.  They are cut into levels (an
    eighth of a unit of cost, and 16 hash groups of keys in each); the leading levels that fit stay."""
    total = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    cost = F.log("total") - F.log("n")
    level = F.floor(cost * 8) * 16 + F.xxhash64("key").bitwiseAND(F.lit(15))
    rows = counts.join(total, ["lang", "size"]).select("lang", "size", "key", cost.alias("cost"), level.alias("level"))
    sizes = rows.groupBy("level").agg(F.count(F.lit(1)).alias("c")).orderBy("level").collect()  # a few thousand at most
    last, taken = -1, 0
    for r in sizes:
        taken += r.c
        if taken > entries:
            break
        last = r.level
    return rows.where(F.col("level") <= last).drop("level")


class Entries:
    """Hashes of words or n-grams, sorted, and the (language number, gain over ``PENALTY``) pairs of each."""

    def __init__(self, key, lang, cost):
        import numpy as np
        key, lang = np.array(key, np.uint64), np.array(lang, np.int64)
        gain = np.rint((PENALTY - np.minimum(np.array(cost, float), PENALTY)) * UNIT)
        order = np.lexsort((lang, key))
        self.lang, self.gain = lang[order], gain[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))

    def find(self, hashes):
        """(whether each is known, its place if so)."""
        import numpy as np
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), int)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at

    def add(self, gains, rows, at) -> None:
        """Adds the gains of the entries ``at`` to ``rows`` of ``gains`` (rows by languages)."""
        import numpy as np
        many = self.first[at + 1] - self.first[at]
        flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[at], many)
        cell = np.repeat(rows, many) * gains.shape[1] + self.lang[flat]
        gains += np.bincount(cell, self.gain[flat], gains.size).reshape(gains.shape)


class Model:
    """Languages, known words, and known n-grams by size."""

    def __init__(self, languages: list[str], words: Entries, grams: dict[int, Entries]):
        self.languages, self.words, self.grams = languages, words, grams

    def gains(self, chars: Characters, word, hashes):
        """(words by languages) of what the words say; ``word``: their numbers, ``hashes``: theirs."""
        import numpy as np
        out = np.zeros((len(word), len(self.languages)))
        known, at = self.words.find(hashes)
        self.words.add(out, np.flatnonzero(known), at[known])
        left = np.flatnonzero(~known)
        for size in sorted(self.grams, reverse=True):
            if not len(left):
                break
            place, key = chars.grams(word[left], size)
            found, at = self.grams[size].find(key)
            place, at = place[found], at[found]
            n = np.bincount(place, minlength=len(left))
            part = np.zeros((len(left), len(self.languages)))
            self.grams[size].add(part, place, at)
            hit = n > 0
            out[left[hit]] = np.rint(part[hit] / n[hit, None])
            left = left[~hit]
        return out

    def __call__(self, texts) -> tuple[list[str], list[float]]:
        """Languages and scores of an iterable of texts."""
        import numpy as np
        texts = list(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), int)
        for rows, offsets, text in slabs(texts):
            chars, row = words_of(rows, offsets, text)
            n += np.bincount(row, minlength=len(texts))
            if not self.languages or not len(row):
                continue
            keys, first, of = np.unique(chars.hashes(chars.starts, chars.ends), return_index=True, return_inverse=True)
            gains = self.gains(chars, first, keys)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, gains[of, k], len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = total.argmax(axis=1) if len(texts) else np.zeros(0, int)
        top = total.max(axis=1, keepdims=True) if len(texts) else total
        score = np.where(n > 0, 1 / np.exp(np.maximum((total - top) / UNIT, -700.0)).sum(axis=1), 0.0)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, n)], score.tolist()


def train(rows: DataFrame, text: str = "text", lang: str = "lang", word_entries: int = WORD_ENTRIES,
          gram_entries: int = GRAM_ENTRIES, grams: int = GRAMS) -> Model:
    """The model of all rows with a language."""
    named = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull())
    counted = cut_lineage(named.mapInArrow(_count_words, "lang string, word string, n bigint")
                          .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    pieces = cut_lineage(counted.mapInArrow(_count_grams(grams), "lang string, size int, key bigint, n bigint")
                         .groupBy("lang", "size", "key").agg(F.sum("n").alias("n")))
    short = counted.where(F.length("word") <= WORD_CHARS).select("lang", F.lit(0).alias("size"), F.col("word").alias("key"), "n")
    words, parts = (t.toArrow() for t in (_most_frequent(short, word_entries), _most_frequent(pieces, gram_entries)))
    languages = sorted({x for t in (words, parts) for x in t.column("lang").unique().to_pylist()})
    return _model(languages, words, parts, grams)


def _model(languages: list[str], words, parts, grams: int) -> Model:
    import numpy as np
    import pyarrow.compute as pc
    import pyarrow as pa
    number = lambda t: pc.index_in(t.column("lang"), pa.array(languages, pa.string())).to_numpy()
    chars = Characters(" " + " ".join(words.column("key").to_pylist()) + " ")
    known = Entries(chars.hashes(chars.starts, chars.ends), number(words), words.column("cost").to_numpy())
    size, key, lang = parts.column("size").to_numpy(), parts.column("key").to_numpy().view(np.uint64), number(parts)
    cost = parts.column("cost").to_numpy()
    return Model(languages, known, {k: Entries(key[size == k], lang[size == k], cost[size == k]) for k in range(1, grams + 1)})


def identify(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of every text and its score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        import pyarrow as pa
        lang, sure = shared.value(t.as_py() for t in texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["lang", "score"])

    c = fresh(df, "_identified")
    found: Column = F.arrow_udf(run, "struct<lang string, score double>")(F.col(text))
    return df.withColumn(c, found).withColumns({lang_pred: F.col(f"{c}.lang"), score: F.col(f"{c}.score")}).drop(c)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learnt from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).drop("text")


@register("op13_word_langid")
def op13_word_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))
