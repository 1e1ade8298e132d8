"""Model evaluation: error metrics, rank correlations, leaderboards.

All metrics are grouped (``by``) so one job scores many models / eval sets.  A pair
without a label or without a prediction is left out of every metric and counted
in ``n_incomplete``.

* MAE, RMSE, R^2 (1 - SSE / (n * var_pop(y))), share within k ranks: one
  aggregation with map-side partial aggregates.
* Spearman: average ranks of the distinct values of a group, numbered by a
  range-partitioned prefix sum, then the correlation over distinct cells.  One path
  whatever the number of distinct values; no task holds all values of a group.
* Kendall tau-b counts inversions: in the order of (label, prediction), a pair of
  cells is discordant if and only if its predictions stand the wrong way round.  The cells
  are cut by range into slabs.  A slab's own inversions are counted in its task, by halves;
  those between slabs by halves too, where the halves of a level are runs of slabs and one
  running sum in the order of predictions counts a whole level.  So the work is
  cells times log(cells), on ranks or on unrounded predictions, and no task holds more than a slab.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F, types as T

from rankline.functions.columns import half_even_int
from rankline.schema import ACCURACY_KS
from rankline.session import cut_lineage


def error_metrics(pairs: DataFrame, by: list[str], y: str = "y", p: str = "p",
                  round_for_accuracy: bool = True) -> DataFrame:
    whole = F.col(y).isNotNull() & F.col(p).isNotNull()
    yy, pp = F.when(whole, F.col(y).cast("double")), F.when(whole, F.col(p).cast("double"))
    err = pp - yy
    pa = half_even_int(p).cast("double") if round_for_accuracy else pp
    aerr = F.when(whole, F.abs(pa - yy))
    agg = pairs.groupBy(*by).agg(
        F.count(err).alias("n"),
        F.count_if(~whole).alias("n_incomplete"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(yy).alias("_var"),
        *[F.avg(F.when(aerr <= k, 1.0).when(aerr > k, 0.0)).alias(f"accuracy_{k}") for k in ACCURACY_KS],
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("n")))
    return agg.withColumn("r2", r2).drop("_sse", "_var")


def complete_pairs(pairs: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    return pairs.select(*by, y, p).where(F.col(y).isNotNull() & F.col(p).isNotNull())


def _cells(pairs: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """(by, y, p, n): the complete pairs collapsed to distinct cells (partial aggregation).

    The cells are written to the shared checkpoint folder: every rank statistic
    reads this table instead of recomputing the upstream pipeline.
    """
    return cut_lineage(complete_pairs(pairs, by, y, p).groupBy(*by, y, p).agg(F.count(F.lit(1)).cast("double").alias("n")))


def _avg_ranks(cells: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, value) -> average 1-based rank of the value within its group (ties averaged).

    Distinct values are range-partitioned in order and written with their partition number;
    the rank of a value is the rows of its group in earlier partitions (one row per partition
    and group) plus a running sum inside its partition.
    """
    hist = cells.groupBy(*by, c).agg(F.sum("n").alias("_k")).repartitionByRange(*by, c)
    hist = cut_lineage(hist.withColumn("_part", F.spark_partition_id()))
    parts = hist.groupBy(*by, "_part").agg(F.sum("_k").alias("_s"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_before"))
    inside = W.partitionBy(*by, "_part").orderBy(c).rowsBetween(W.unboundedPreceding, -1)
    x = hist.withColumn("_in", F.coalesce(F.sum("_k").over(inside), F.lit(0.0))).join(parts, [*by, "_part"])
    return x.select(*by, c, (F.col("_before") + F.col("_in") + (F.col("_k") + 1) / 2.0).alias(f"_r_{c}"))


def spearman(pairs: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Spearman = Pearson correlation of average ranks, weighted over distinct cells."""
    return _spearman(_cells(pairs, by, y, p), by, y, p)


def _spearman(cells: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    x = cells.join(_avg_ranks(cells, by, y), [*by, y]).join(_avg_ranks(cells, by, p), [*by, p])
    # ranks are centred by the mean rank (N + 1) / 2 before they are multiplied
    size = cells.groupBy(*by).agg(F.sum("n").alias("_n"))
    x = x.join(size, by) if by else x.crossJoin(F.broadcast(size))
    a, b, n = F.col(f"_r_{y}") - (F.col("_n") + 1) / 2, F.col(f"_r_{p}") - (F.col("_n") + 1) / 2, F.col("n")
    m = x.groupBy(*by).agg(F.sum(n * a * a).alias("_saa"), F.sum(n * b * b).alias("_sbb"), F.sum(n * a * b).alias("_sab"))
    # a constant side has no rank variance: correlation undefined (NULL)
    rho = F.when((F.col("_saa") > 0) & (F.col("_sbb") > 0), F.col("_sab") / F.sqrt(F.col("_saa") * F.col("_sbb")))
    return m.select(*by, rho.alias("spearman"))


# Distinct (label, prediction) cells that one task counts by itself.
SLAB_CELLS = 1_000_000


def kendall_tau_b(pairs: DataFrame, by: list[str], y: str = "y", p: str = "p", rounded: bool = True,
                  slab_cells: int = SLAB_CELLS) -> DataFrame:
    """Kendall tau-b per group (exact), over half-even rounded ranks unless ``rounded`` is false."""
    return _kendall(_cells(_rounded(pairs, y, p) if rounded else pairs, by, y, p), by, y, p, slab_cells)


def _rounded(pairs: DataFrame, y: str, p: str) -> DataFrame:
    return pairs.withColumns({y: half_even_int(y), p: half_even_int(p)})


def _kendall(cells: DataFrame, by: list[str], y: str, p: str, slab_cells: int = SLAB_CELLS) -> DataFrame:
    """tau-b from the pairs that tie in label, prediction or both, and the discordant ones."""
    tied, wrong = _ties(cells, by, y, p), inversions(cells, by, y, p, slab_cells)
    x = tied.join(wrong, by, "left") if by else tied.crossJoin(wrong)  # one row each without groups
    balance = (F.col("_n0") - F.col("_n1") - F.col("_n2") + F.col("_n3")) - 2 * F.coalesce("_nd", F.lit(0.0))
    denom = F.sqrt((F.col("_n0") - F.col("_n1")) * (F.col("_n0") - F.col("_n2")))
    return x.select(*by, F.when(denom > 0, balance / denom).alias("kendall"))


def _ties(cells: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """(by, _n0, _n1, _n2, _n3): pairs at all, pairs that tie in y, in p, in both."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ny = cells.groupBy(*by, y).agg(F.sum("n").alias("_m")).groupBy(*by).agg(two("_m").alias("_n1"))
    np_ = cells.groupBy(*by, p).agg(F.sum("n").alias("_m")).groupBy(*by).agg(two("_m").alias("_n2"))
    n = cells.groupBy(*by).agg(F.sum("n").alias("_N"), two("n").alias("_n3"))
    t = n.join(ny, by).join(np_, by) if by else n.crossJoin(ny).crossJoin(np_)  # one row each without groups
    return t.withColumn("_n0", F.col("_N") * (F.col("_N") - 1) / 2).drop("_N")


def inversions(cells: DataFrame, by: list[str], y: str, p: str, slab_cells: int = SLAB_CELLS) -> DataFrame:
    """(by, _nd): weighted pairs of cells (by, y, p, n) of which one has the smaller y and the greater p.

    ``cells`` is a written table with one row per (by, y, p).
    """
    slabs = max(1, -(-cells.count() // slab_cells))
    cut = cut_lineage(cells.select(*by, y, p, "n").repartitionByRange(slabs, *by, y, p)
                      .withColumn("_slab", F.spark_partition_id()))
    parts = [_inside(cut, by, y, p)]
    if slabs > 1:
        parts.append(_between(cut, by, y, p, (slabs - 1).bit_length()))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy(*by).agg(F.sum("_nd").alias("_nd"))


def weighted_inversions(v, w):
    """For every place j of ``v``: the sum of ``w`` over the places before it with a greater value.

    Places are halved again and again; on each level one running sum in falling order of ``v`` serves all
    pairs of neighbouring halves."""
    import numpy as np
    n, out = len(v), np.zeros(len(v))
    at = np.arange(n)
    falling = np.lexsort((-at, -v))  # among equal values the later place first, so that equals do not count
    for level in range(max(n - 1, 0).bit_length()):
        order = falling[np.argsort(falling >> (level + 1), kind="stable")]
        block, left = order >> (level + 1), (order >> level) & 1 == 0
        total = np.concatenate([[0.0], np.cumsum(np.where(left, w[order], 0.0))])
        first = np.searchsorted(block, block)
        out[order] += np.where(left, 0.0, total[:-1] - total[first])
    return out


def _inside(cut: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Inversions inside the slabs, one row per slab and group."""
    def count(table):
        import numpy as np
        import pyarrow as pa
        code = lambda c: np.unique(table.column(c).to_numpy(), return_inverse=True)[1]
        group = np.zeros(len(table), np.int64)
        for c in by:
            one = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.unique(np.stack([group, one]), axis=1, return_inverse=True)[1].ravel()
        pc = code(p)
        order = np.lexsort((pc, code(y), group))
        # groups lie one behind another and rise, so no pair of two groups is an inversion
        v, w = group[order] * (len(table) + 1) + pc[order], table.column("n").to_numpy()[order]
        found = np.bincount(group[order], w * weighted_inversions(v, w))
        row = np.unique(group, return_index=True)[1]
        return pa.table([*(table.column(c).take(pa.array(row)) for c in by), pa.array(found)], [*by, "_nd"])

    fields = [f for f in cut.schema.fields if f.name in by]
    schema = T.StructType([*sorted(fields, key=lambda f: by.index(f.name)), T.StructField("_nd", T.DoubleType())])
    return cut.groupBy("_slab").applyInArrow(count, schema)


def _between(cut: DataFrame, by: list[str], y: str, p: str, levels: int) -> DataFrame:
    """Inversions between slabs: two slabs meet at the highest bit in which their numbers differ."""
    x = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
    x = x.withColumns({"_block": F.expr("shiftright(_slab, _level + 1)"), "_right": F.expr("shiftright(_slab, _level) & 1")})
    # greatest prediction first and right halves first among equals: what a right cell has before it is greater
    falling = [F.col(p).desc(), F.col("_right").desc(), F.col(y)]
    place = [*by, "_level", "_block"]
    x = cut_lineage(x.repartitionByRange(*place, *falling).withColumn("_part", F.spark_partition_id()))
    left = F.when(F.col("_right") == 0, F.col("n")).otherwise(0.0)
    parts = x.groupBy(*place, "_part").agg(F.sum(left).alias("_sum"))
    earlier = W.partitionBy(*place).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*place, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    here = W.partitionBy(*place, "_part").orderBy(*falling).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum(left).over(here), F.lit(0.0))).join(parts, [*place, "_part"])
    return x.where(F.col("_right") == 1).select(*by, (F.col("n") * (F.col("_before") + F.col("_in"))).alias("_nd"))


def all_metrics(pairs: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Leaderboard metrics per group: n, mae, rmse, r2, spearman, kendall, accuracy_k.

    The pairs are scored once: they are written to the shared folder and every metric reads them.
    """
    pairs = cut_lineage(pairs.select(*by, y, p))
    base = error_metrics(pairs, by, y, p)
    sp, kd = spearman(pairs, by, y, p), kendall_tau_b(pairs, by, y, p)
    if by:
        return base.join(sp, by, "left").join(kd, by, "left")
    return base.crossJoin(sp).crossJoin(kd)


def flag_best(board: DataFrame, group: str = "eval_set") -> DataFrame:
    """is_best_model = lowest MAE within one evaluation set (never across sets)."""
    w = W.partitionBy(group)
    return board.withColumn("is_best_model", F.col("mae") == F.min("mae").over(w))


def merge_leaderboards(base: DataFrame, replacement: DataFrame, baseline: DataFrame | None = None,
                       key: str = "model_name", rename: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``replacement`` replace same-named rows of ``base``; others kept; baseline appended.

    ``rename`` maps names of ``replacement`` to those of the merged board first (a retrained model
    takes the place of its older variant).
    """
    if rename:
        pairs = [F.lit(x) for item in rename.items() for x in item]
        replacement = replacement.withColumn(key, F.coalesce(F.create_map(*pairs)[F.col(key)], F.col(key)))
    kept = base.join(replacement.select(key), key, "left_anti")
    out = kept.unionByName(replacement, allowMissingColumns=True)
    if baseline is not None:
        out = out.unionByName(baseline, allowMissingColumns=True)
    return out


def time_cutoff(df: DataFrame, ts: str = "UpdateDT", num: int = 4, den: int = 5,
                fanout: int = 4096) -> int | None:
    """Exact k-th smallest time in micros, k = ceil(N * num / den) (radix select).

    Each pass is a filter + bounded histogram (<= ``fanout`` buckets) over one
    column; about four passes pin down the exact value.  No task ever sees all
    values and nothing unbounded reaches the driver.
    """
    v = F.unix_micros(F.col(ts).cast("timestamp"))
    col = df.select(v.alias("_t")).where(F.col("_t").isNotNull())
    st = col.agg(F.count(F.lit(1)), F.min("_t"), F.max("_t")).first()
    n, lo, hi = int(st[0]), st[1], st[2]
    if n == 0:
        return None
    k = -(-n * num // den)  # ceil
    while True:
        span = hi - lo + 1
        if span <= fanout:
            hist = (col.where(F.col("_t").between(lo, hi)).groupBy("_t").count().orderBy("_t").collect())
            for r in hist:
                if k <= r["count"]:
                    return int(r["_t"])
                k -= r["count"]
            return int(hi)
        width = -(-span // fanout)
        b = F.floor((F.col("_t") - F.lit(lo)) / F.lit(width))
        hist = (col.where(F.col("_t").between(lo, hi)).groupBy(b.alias("_b")).count().orderBy("_b").collect())
        for r in hist:
            if k <= r["count"]:
                lo, hi = lo + int(r["_b"]) * width, min(hi, lo + (int(r["_b"]) + 1) * width - 1)
                break
            k -= r["count"]


def time_split(df: DataFrame, ts: str = "UpdateDT", num: int = 4, den: int = 5) -> DataFrame:
    """Label rows 'train' (time <= cutoff) or 'test' (newest rows); rows without a time get NULL."""
    cut = time_cutoff(df, ts, num, den)
    v = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumns({
        "split": F.when(v <= F.lit(cut), F.lit("train")).when(v > F.lit(cut), F.lit("test")),
        "cutoff": F.timestamp_micros(F.lit(cut)).cast("timestamp_ntz"),
    })
