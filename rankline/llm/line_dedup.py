"""Line dedup: repeated runs of lines by a distributed suffix array.

Every line with a word becomes a line id (a 96-bit hash of the trimmed line); a document is
a sequence of line ids, and all documents together are one text whose suffixes are ranked.

1. *Pruning.*  A line that occurs once ends every repeated run, so only lines that occur again
   are kept; a gap in the positions ends a suffix.  With ``across_blank`` the positions number
   the lines with a word only, so blank lines between paragraphs are no gaps.
2. *Prefix doubling.*  Rank 0 orders suffixes by their first line.  Round ``k`` takes the pair
   (rank at p, rank at p + 2^k), 0 beyond a gap, and ranks the pairs: a suffix's new rank is its
   old one plus the number of suffixes of its old group with a smaller second rank.  After the
   round, equal rank means equal first 2^(k+1) lines, and ranks follow the suffix array's order.
   Doubling ends when no group splits any more, or at the depth that ``min_words`` can reach
   (a run of n words has at most n lines); deeper ranks would only split the intervals found.
3. *LCP intervals.*  The suffixes that share their first m lines form one interval of the
   suffix array.  It is named by the ranks of the two overlapping blocks of 2^k lines, 2^k <= m,
   that cover its first m lines.  For every position the shortest run of ``min_words`` words
   that begins there, and the one that ends there, is looked up in its interval; the copy that
   comes first in the order of (doc_id, hash of the text, position) stays.  The others are later
   copies, but for those that overlap it: a copy in the same document counts from the end of the one that
   stays on.  A maximal repeated run is the union of such runs: each of its lines lies in one that
   begins at the line or, among its last words, in the one that ends where it ends, and no line
   outside a repeated run lies in any (what holds for a run that does not overlap its first copy holds for
   its parts).  So the lines of all later copies are deleted, and the first copy of every run stays
   whole.  Neighbouring later copies at the same distance from their first copies are put together again:
   these are the maximal runs that ``runs`` reports.

Plan: the texts are read once to cut lines (narrow rows are written to the shared folder) and
once to delete lines; everything between works on narrow rows.  Groups are counted by partial
aggregation before ranks are numbered, and a group's running sum is taken over blocks of
``BLOCK`` ranks first, so a line that a third of all rows share is never one task's work.
Joins on line ids and intervals have one row per key on one side, which is written before an interval's
join so that both sides are shuffled for it: AQE can split hot keys then.

Defined results: blank lines are no lines here and are never deleted; with ``across_blank``, as
the query and the pipeline run it, a run goes on behind them, without it a blank line ends a run; NULL and empty texts pass
through; NULL ids come last; rows that repeat both doc_id and text are the same document and
get the same result; rows that share a doc_id but not the text are documents of their own.
Extra columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankline.llm.common import WORD, table
from rankline.llm.registry import register
from rankline.session import cut_lineage

MIN_WORDS = 50
BLOCK = 65_536
SPACE = " \t\n\x0b\x0c\r"


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines(docs: DataFrame, across_blank: bool = False) -> DataFrame:
    """(d, t, pos, a, b, n): document key, line position, line id in two parts, words of the line.

    ``pos`` counts the lines with a word if ``across_blank``, else all lines."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    if across_blank:
        trimmed = F.filter(trimmed, lambda x: x != "")
    cut = docs.select(F.col("doc_id").alias("d"), _text_key(F.col("text")).alias("t"),
                      F.posexplode(trimmed).alias("pos", "line")).where(F.col("line") != "")
    return cut.select("d", "t", "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"),
                      F.regexp_count("line", F.lit(WORD)).alias("n"))


def _first_ranks(rows: DataFrame) -> DataFrame:
    """(a, b, r0) of the line ids that occur again; r0 - 1 is the number of kept rows with smaller ids."""
    ids = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    ids = cut_lineage(ids.withColumn("block", F.shiftrightunsigned("a", 48)))
    before = Window.unboundedPreceding
    blocks = (ids.groupBy("block").agg(F.sum("c").alias("c"))
              .select("block", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(before, -1)), F.lit(0)).alias("s")))
    inside = Window.partitionBy("block").orderBy("a", "b").rowsBetween(before, -1)
    return (ids.withColumn("x", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(blocks, "block")
            .select("a", "b", (F.col("s") + F.col("x") + 1).alias("r0")))


def _next_ranks(pairs: DataFrame) -> DataFrame:
    """(r, q, s): new rank of every pair; ``pairs``: (r, q, c) with the number of rows of each pair."""
    pairs = pairs.withColumn("block", F.floor(F.col("q") / BLOCK))
    before = Window.unboundedPreceding
    blocks = pairs.groupBy("r", "block").agg(F.sum("c").alias("c"))
    blocks = blocks.select("r", "block", F.coalesce(
        F.sum("c").over(Window.partitionBy("r").orderBy("block").rowsBetween(before, -1)), F.lit(0)).alias("x"))
    inside = Window.partitionBy("r", "block").orderBy("q").rowsBetween(before, -1)
    return (pairs.withColumn("y", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(blocks, ["r", "block"])
            .select("r", "q", (F.col("r") + F.col("x") + F.col("y")).alias("s")))


def ranked_suffixes(rows: DataFrame, max_lines: int) -> tuple[DataFrame, int]:
    """(d, t, pos, n, r0 .. rk) of the lines that occur again, and k."""
    kept = rows.join(_first_ranks(rows), ["a", "b"]).select("d", "t", "pos", "n", "r0").dropDuplicates(["d", "t", "pos"])
    kept, k = cut_lineage(kept), 0
    groups = kept.select("r0").distinct().count()
    while 2 ** (k + 1) <= max_lines:
        ahead = Window.partitionBy("d", "t").orderBy("pos").rangeBetween(2 ** k, 2 ** k)
        now = kept.withColumn("q", F.coalesce(F.max(f"r{k}").over(ahead), F.lit(0)))
        pairs = cut_lineage(now.groupBy(F.col(f"r{k}").alias("r"), "q").agg(F.count(F.lit(1)).alias("c")))
        split = pairs.count()
        if split == groups:
            break
        groups = split
        new = _next_ranks(pairs).select(F.col("r").alias(f"r{k}"), "q", F.col("s").alias(f"r{k + 1}"))
        kept = cut_lineage(now.join(new, [f"r{k}", "q"]).drop("q"))
        k += 1
    return kept, k


def _runs(kept: DataFrame, k: int, min_words: int) -> DataFrame:
    """(d, t, start, m, level, x, y): shortest runs of ``min_words`` words, named by their LCP interval."""
    ranks = [f"r{i}" for i in range(k + 1)]
    of_doc = kept.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "n", *ranks))).alias("rows"))

    @F.arrow_udf("array<struct<start bigint, m bigint, level bigint, x bigint, y bigint>>")
    def run(docs):
        import numpy as np
        import pyarrow as pa
        out, ends = [], [0]
        for doc in docs:
            rows = doc.values
            pos = rows.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            words = rows.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.stack([rows.field(r).to_numpy(zero_copy_only=False) for r in ranks])
            total = np.concatenate([[0], np.cumsum(words)])
            at = np.arange(len(pos))
            stretch = np.concatenate([[0], np.cumsum(np.diff(pos) != 1)])
            first = np.searchsorted(stretch, stretch)          # where the row's stretch begins
            last = np.searchsorted(stretch, stretch, "right")  # and ends
            # shortest run that begins at the row: up to the first end with enough words
            till = np.searchsorted(total, total[at] + min_words)
            # shortest run that ends at the row: from the last begin with enough words
            since = np.searchsorted(total, total[at + 1] - min_words, "right") - 1
            ok_a, ok_b = till <= last, (total[at + 1] - min_words >= total[first])
            start = np.concatenate([at[ok_a], since[ok_b]])
            m = np.concatenate([till[ok_a] - at[ok_a], at[ok_b] + 1 - since[ok_b]])
            level = np.minimum(np.floor(np.log2(np.maximum(m, 1))).astype(np.int64), len(ranks) - 1)
            got = np.stack([pos[start], m, level, rank[level, start], rank[level, start + m - (1 << level)]])
            got = np.unique(got, axis=1) if got.shape[1] else got
            out.append(got)
            ends.append(ends[-1] + got.shape[1])
        whole = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in whole], ["start", "m", "level", "x", "y"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)

    return of_doc.select("d", "t", F.explode(run("rows")).alias("run")).select("d", "t", "run.*")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, across_blank: bool = False) -> DataFrame:
    """(d, t, copies): per document with deletions, the array of (start, m, from_doc, from_start) of its later copies."""
    rows = cut_lineage(lines(docs.select("doc_id", "text"), across_blank))
    kept, k = ranked_suffixes(rows, min_words)
    runs = cut_lineage(_runs(kept, k, min_words))
    place = F.struct(F.col("d").isNull().alias("o"), "d", "t", "start")
    interval = ["m", "level", "x", "y"]
    first = cut_lineage(runs.groupBy(*interval).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
                        .where(F.col("c") > 1).drop("c"))
    same_doc = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("t") == F.col("first.t"))
    later = runs.join(first, interval).where(~same_doc | (F.col("start") >= F.col("first.start") + F.col("m")))
    return later.groupBy("d", "t").agg(F.sort_array(F.collect_list(
        F.struct("start", "m", F.col("first.d").alias("from_doc"), F.col("first.start").alias("from_start")))).alias("copies"))


def _join(joined: list[list[int]], a: int, b: int) -> None:
    """Adds [a, b) to ranges that begin no later."""
    if joined and a <= joined[-1][1]:
        joined[-1][1] = max(b, joined[-1][1])
    else:
        joined.append([a, b])


RUN = "struct<start:bigint,lines:bigint,from_doc:bigint,from_start:bigint>"
CUT = f"struct<text:string,removed:array<array<bigint>>,n_removed:bigint,runs:array<{RUN}>>"


def maximal_runs(copies: list[dict]) -> list[dict]:
    """Copies, by rising start, put together where they touch and lie at the same distance from their first copies."""
    open_: dict[tuple, list[list[int]]] = {}
    for c in copies:
        _join(open_.setdefault((c["from_doc"], c["start"] - c["from_start"]), []), c["start"], c["start"] + c["m"])
    found = [(a, b - a, doc, a - away) for (doc, away), ranges in open_.items() for a, b in ranges]
    found.sort(key=lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0))
    return [dict(zip(("start", "lines", "from_doc", "from_start"), r)) for r in found]


def _delete(texts, copies, across_blank):
    """The text without the lines of the runs, the runs joined up as [start, end), the number of lines.

    The ranges count all lines of the text; blank lines inside a run stay and divide its range."""
    import pyarrow as pa
    out = []
    for t, c in zip(texts, copies):
        if not t.is_valid or not c.is_valid:
            out.append(None)
            continue
        parts, kept, at = t.as_py().split("\n"), [], 0
        joined: list[list[int]] = []
        for run in c.as_py():
            _join(joined, run["start"], run["start"] + run["m"])
        if across_blank:
            solid, numbered, joined = [i for i, x in enumerate(parts) if x.strip(SPACE)], joined, []
            for a, b in numbered:
                for i in solid[a:b]:
                    _join(joined, i, i + 1)
        for a, b in joined:
            kept += parts[at:a]
            at = b
        kept += parts[at:]
        out.append({"text": "\n".join(kept), "removed": joined, "n_removed": sum(b - a for a, b in joined),
                    "runs": maximal_runs(c.as_py())})
    run = pa.struct([(n, pa.int64()) for n in ("start", "lines", "from_doc", "from_start")])
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64()))), ("n_removed", pa.int64()),
                                    ("runs", pa.list_(run))]))


def _joined(docs: DataFrame, min_words: int, across_blank: bool) -> DataFrame:
    """Rows of ``docs`` as a struct _row, with their copies and the struct _cut (NULL: nothing to delete)."""
    copies = later_copies(docs, min_words, across_blank).select(F.col("d").alias("_d"), F.col("t").alias("_t"), "copies")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), _text_key(F.col("text")).alias("_key"))
    both = rows.join(copies, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left")
    # texts without deletions do not travel to Python
    cut = F.arrow_udf(lambda texts, copies: _delete(texts, copies, across_blank), CUT)
    return both.withColumn("_cut", cut(F.when(F.col("copies").isNotNull(), F.col("_row.text")), F.col("copies")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, across_blank: bool = False) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the later copies of repeated runs."""
    both = _joined(docs, min_words, across_blank)
    return both.select(*[F.coalesce("_cut.text", "_row.text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`")
                         for c in docs.columns])


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, cleaned text, number of removed lines, removed line ranges, documents that hold the first copies, and
    the maximal repeated runs with their first copies (in lines with a word)."""
    both = _joined(table(spark, sf_dir, "documents"), MIN_WORDS, across_blank=True)
    return both.select(F.col("_id").alias("doc_id"), F.coalesce("_cut.text", "_row.text").alias("text"),
                       F.coalesce("_cut.n_removed", F.lit(0)).cast("long").alias("n_removed"),
                       F.col("_cut.removed").alias("removed"),
                       F.array_sort(F.array_distinct(F.transform("copies", lambda c: c["from_doc"]))).alias("first_copies"),
                       F.col("_cut.runs").alias("runs"))
