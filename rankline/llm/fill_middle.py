"""Fill-in-middle: a text's prefix, middle and suffix, re-ordered for training.

A unit is a run of the letters A-Z, a-z or any other single character.  Where the two cuts of a
text fall depends on its number of units and on units counted from its start, so units have to
be counted; texts share long passages, so the counting is memoised by content:

1. *Chunks.*  A rolling hash over the last 32 bytes (shifted sums of one table value a byte,
   taken over a whole batch at once) ends a chunk wherever its low bits are zero, so equal passages
   are cut into equal chunks wherever they stand.  Chunks have ``LEAST`` to ``MOST`` bytes.
2. *Summaries.*  The worker keeps, by the bytes of a chunk (equal hashes alone prove nothing:
   the look-up compares contents), the number of units and characters in it and whether it begins and ends with a
   letter.  A boundary between two letters joins two units into one, so counts of chunks combine
   by addition, less one for every such boundary.
3. *Cuts.*  The running unit counts of a text's chunks name the chunk that holds a cut; only that
   chunk is looked into.

Everything else (hash draws, the pieces, the output and the way back) is Spark SQL.

Plan: row-local, no shuffle.  A worker keeps at most ``MEMO_BYTES`` of chunks, and is given
``SLAB`` bytes of texts, or one longer text, at a time.

Defined results: a NULL text is an empty one; empty texts and texts that hold one of the three
marks are plain: their output is the text.  A NULL id draws as an empty one would.  Repeated rows
are all returned, alike.  Other columns pass through; columns that have the names of the new ones
are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, table
from rankline.llm.registry import register

# Marks in front of the prefix, the suffix and the middle: fixed by the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Percentages of a hash draw: texts formatted at all, and those of them with the suffix first.
FORMATTED, SUFFIX_FIRST = 90, 20

WINDOW = 32
LEAST, MOST, MEAN_BITS = 64, 2048, 8
MEMO_BYTES = 64 << 20
SLAB = 4 << 20


def _tables():
    """(rolling hash value of each byte, 1: letter, 2: continues a character, 0: any other byte)."""
    import numpy as np
    gear = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)
    kind = np.zeros(256, np.uint8)
    kind[list(range(65, 91)) + list(range(97, 123))] = 1
    kind[128:192] = 2
    return gear, kind


def boundaries(data, starts, gear):
    """Ends of the chunks of texts that lie one behind another in ``data`` (uint8); ``starts``: where
    each begins, and the end of the last.  Returns one list of ends per text."""
    import numpy as np
    h = gear[data]
    for k in (1, 2, 4, 8, 16):  # after each step the sum is over twice as many bytes
        if len(h) > k:
            longer = h.copy()
            longer[k:] += h[:-k] << np.uint32(k)
            h = longer
    # the top bits depend on the whole window
    at = (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist()
    out, i, n = [], 0, len(at)
    for a, b in zip(starts[:-1], starts[1:]):
        ends, last = [], a
        # a candidate at least LEAST > WINDOW bytes behind the start does not depend on the text before
        while i < n and at[i] < b:
            if at[i] - last >= LEAST:
                while at[i] - last > MOST:
                    last += MOST
                    ends.append(last)
                if at[i] - last >= LEAST:
                    last = at[i]
                    ends.append(last)
            i += 1
        while b - last > MOST:
            last += MOST
            ends.append(last)
        if b > last:
            ends.append(b)
        while i < n and at[i] <= b:
            i += 1
        out.append(ends)
    return out


class ChunkMemo:
    """Summaries of chunks, by their content: (units, characters, begins and ends with a letter)."""

    def __init__(self, kind):
        self.kind, self.known, self.bytes = kind, {}, 0

    def starts_of(self, chunk: bytes, after_letter: bool):
        """(byte offsets where the chunk's units begin, byte offsets where its characters begin)."""
        import numpy as np
        kind = self.kind[np.frombuffer(chunk, np.uint8)]
        letter = kind == 1
        inner = np.empty(len(kind), bool)
        inner[0], inner[1:] = after_letter, letter[:-1]
        return np.flatnonzero((kind != 2) & ~(letter & inner)), np.flatnonzero(kind != 2)

    def __call__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        got = self.known.get(chunk)
        if got is None:
            units, chars = self.starts_of(chunk, False)
            got = (len(units), len(chars), bool(self.kind[chunk[0]] == 1), bool(self.kind[chunk[-1]] == 1))
            if self.bytes > MEMO_BYTES:
                self.known.clear()
                self.bytes = 0
            self.known[chunk] = got
            self.bytes += len(chunk) + 200
        return got

    def cuts(self, raw: bytes, ends: list[int], draws: tuple[int, int]) -> tuple[int, int, int]:
        """(units, characters before the first cut, characters before the second)."""
        units, chars, letters, parts, a = [0], [0], [False], [], 0
        for b in ends:
            chunk = raw[a:b]
            u, c, begins, finishes = self(chunk)
            units.append(units[-1] + u - (begins and letters[-1]))
            chars.append(chars[-1] + c)
            letters.append(finishes)
            parts.append(chunk)
            a = b
        n = units[-1]
        return n, *(self._chars_before(k, n, units, chars, letters, parts) for k in sorted(d % (n + 1) for d in draws))

    def _chars_before(self, k: int, n: int, units, chars, letters, parts) -> int:
        """Characters before unit ``k``, counted from 0; all of them for ``k`` = ``n``."""
        import numpy as np
        from bisect import bisect_right
        if k == n:
            return chars[-1]
        at = bisect_right(units, k) - 1  # the chunk in which unit k begins
        begin, all_chars = self.starts_of(parts[at], letters[at])
        return chars[at] + int(np.searchsorted(all_chars, begin[k - units[at]]))


_MEMO: list[ChunkMemo] = []


def _slabs(texts):
    """(first row, rows as bytes) of about ``SLAB`` bytes each."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.as_py()
        raw = raw.encode() if raw else b""
        if rows and size + len(raw) > SLAB:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(raw)
        size += len(raw)
    if rows:
        yield first, rows


def _count(texts, h1, h2):
    """Units and cuts of a batch of texts with their first two draws."""
    import numpy as np
    import pyarrow as pa
    gear, kind = _tables()
    if not _MEMO:
        _MEMO.append(ChunkMemo(kind))
    out = []
    for first, rows in _slabs(texts):
        starts = np.cumsum([0, *map(len, rows)]).tolist()
        ends = boundaries(np.frombuffer(b"".join(rows), np.uint8), starts, gear)
        for i, (raw, start, found) in enumerate(zip(rows, starts, ends), first):
            out.append(_MEMO[0].cuts(raw, [e - start for e in found], (h1[i].as_py(), h2[i].as_py())))
    n, a, b = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, a, b)], ["n", "first", "second"])


def draw(doc_id: Column, group: int) -> Column:
    """Unsigned integer of the ``group``-th (from 0) eight hex digits of a document's hash."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", formatted: int = FORMATTED,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add n, form (plain, psm or spm), prefix_chars, middle_chars and output to every row of ``docs``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    c, f = fresh(docs, "_cut"), fresh(docs, "_form")
    count = F.arrow_udf(_count, "struct<n bigint, first bigint, second bigint>")
    at = docs.withColumn(c, count(raw, draw(F.col(doc_id), 0), draw(F.col(doc_id), 1)))
    marked = raw.contains(PREFIX) | raw.contains(SUFFIX) | raw.contains(MIDDLE)
    plain = (raw == "") | marked | (draw(F.col(doc_id), 2) % 100 >= formatted)
    at = at.withColumn(f, F.when(plain, "plain").when(draw(F.col(doc_id), 3) % 100 < suffix_first, "spm").otherwise("psm"))
    first, second = F.col(f"{c}.first").cast("int"), F.col(f"{c}.second").cast("int")
    p, m = F.substring(raw, F.lit(1), first), F.substring(raw, first + 1, second - first)
    s = F.substring(raw, second + 1, F.length(raw))
    output = (F.when(F.col(f) == "plain", raw)
              .when(F.col(f) == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
              .otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)))
    cut = F.col(f) != "plain"
    return at.withColumns({
        "n": F.col(f"{c}.n"), "form": F.col(f), "prefix_chars": F.when(cut, F.col(f"{c}.first")),
        "middle_chars": F.when(cut, F.col(f"{c}.second") - F.col(f"{c}.first")), "output": output}).drop(c, f)


def restore(output: Column, form: Column) -> Column:
    """The text again.  A formatted text holds no mark, and no mark overlaps another, so the first
    occurrence of each is its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .otherwise(F.concat(parts[2], parts[3], parts[1])))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)
, t AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS units,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
               CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d)
, c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
               greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
               CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t)
, p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
               coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p"""


@register("op11_fill_middle", ORACLE)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of all documents; digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
