"""Ordinal regression with ordered thresholds, fitted jointly with the weights.

A row with features x and class y of K scores z = w . x; the thresholds t_1 <= ... <= t_{K-1} cut the
scores into classes.  The loss is logistic at the thresholds next to the row's class (``immediate``) or at
all of them (``all``): softplus(t_k - z) for k < y, softplus(z - t_k) for k >= y, the mean over the rows
plus reg / 2 |w|^2.  It is convex, so weights and thresholds are fitted together by Newton steps.

The order of the thresholds is kept by fitting their differences, which may not be negative: a
projected step (differences that sit at zero and would fall stay there, the others take the Newton step of
the remaining ones, and what falls below zero is set to zero), shortened until the loss falls.

Plan: the rows (class and features) are written once, in blocks of a few kilobytes.  A pass makes, per task, loss, gradient and
Hessian sums: a class contributes to two thresholds only, so these are about K times the number of
features; Spark adds them up and the driver gets one number per cell, whatever the number of rows.  A
fit takes some ten passes.

Defined results: rows without a label teach nothing; ranks outside 1 .. ``n_ranks`` count as the nearest of
these two; without a labelled row ValueError is raised.  A threshold between two classes without rows
keeps the place that its neighbours allow.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.session import cut_lineage, summed

LABEL = "Rank"


def _logistic(v):
    """(softplus, sigmoid) of ``v``."""
    import numpy as np
    e = np.exp(-np.abs(v))
    return np.maximum(v, 0) + np.log1p(e), np.where(v >= 0, 1.0, e) / (1 + e)


class Sums:
    """Loss, gradient and Hessian sums of rows at weights ``w`` and thresholds ``t``."""

    def __init__(self, w, t, every: bool):
        import numpy as np
        self.w, self.t, self.every = w, t, every
        d, k = len(w), len(t)
        self.loss, self.gw, self.gt = 0.0, np.zeros(d), np.zeros(k)
        self.hww, self.htt, self.hwt = np.zeros((d, d)), np.zeros(k), np.zeros((k, d))

    def add(self, y, x) -> None:
        """Rows of classes ``y`` (1 .. K) and features ``x``."""
        import numpy as np
        if self.every:
            self._add_every(y, x)
            return
        # the rows by class, so that those of a threshold lie together
        k = len(self.t)
        order = np.argsort(y.astype(np.int16) if k < 32_000 else y, kind="stable")  # short numbers sort faster
        y, x = y[order].astype(np.int64), x[order]
        z, g, h = x @ self.w, np.zeros(len(y)), np.zeros(len(y))
        first = np.flatnonzero(np.diff(y, prepend=0))
        low, high = np.searchsorted(y, 2), np.searchsorted(y, k, "right")
        # the score should lie above the threshold below the class and below the one above it, if there are any
        for rows, off, sign in ((slice(low, None), 2, 1.0), (slice(0, high), 1, -1.0)):
            at = y[rows] - off
            loss, p = _logistic(sign * (self.t[at] - z[rows]))
            mine = np.zeros(len(y))
            mine[rows] = p * (1 - p)
            self.loss += loss.sum()
            self.gt += sign * np.bincount(at, p, k)
            self.htt += np.bincount(at, mine[rows], k)
            g[rows] += sign * p
            h += mine
            found = y[first] - off
            here = (found >= 0) & (found < k)
            if here.any():
                self.hwt[found[here]] -= np.add.reduceat(mine[:, None] * x, first, axis=0)[here]
        self.gw -= g @ x
        root = x * np.sqrt(h)[:, None]
        self.hww += root.T @ root  # a matrix times itself takes half the work of two

    def _add_every(self, y, x) -> None:
        import numpy as np
        z, k = x @ self.w, len(self.t)
        at, row = np.tile(np.arange(k), len(y)), np.repeat(np.arange(len(y)), k)
        sign = np.where(at + 1 < y[row], 1.0, -1.0)  # +1: the score should lie above the threshold
        loss, p = _logistic(sign * (self.t[at] - z[row]))
        g, h = sign * p, p * (1 - p)
        self.loss += loss.sum()
        self.gt += np.bincount(at, g, k)
        self.htt += np.bincount(at, h, k)
        per_row = np.bincount(row, h, len(y))
        self.gw -= np.bincount(row, g, len(y)) @ x
        self.hww += (x * per_row[:, None]).T @ x
        if len(at):
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            self.hwt[at[order[first]]] -= np.add.reduceat(h[order, None] * x[row[order]], first, axis=0)

    def flat(self):
        import numpy as np
        return np.concatenate([[self.loss], self.gw, self.gt, self.hww.ravel(), self.htt, self.hwt.ravel()])

    def take(self, flat) -> "Sums":
        """The sums that ``flat`` holds."""
        import numpy as np
        d, k = len(self.w), len(self.t)
        parts = np.split(flat, np.cumsum([1, d, k, d * d, k]))
        self.loss, self.gw, self.gt, self.htt = float(parts[0][0]), parts[1], parts[2], parts[4]
        self.hww, self.hwt = parts[3].reshape(d, d), parts[5].reshape(k, d)
        return self


# Pairs of a row and a threshold and features that a task works on at a time, bytes of features in a block (bounds on memory only).
PAIRS = 16_384
NUMBERS = 262_144
BLOCK_BYTES = 4_096


def runs(kinds: str) -> list[tuple[int, int, str]]:
    """(first, end, type) of each run of neighbouring features of the same type."""
    from itertools import groupby
    out, at = [], 0
    for k, same in groupby(kinds):
        out.append((at, at + len(list(same)), k))
        at = out[-1][1]
    return out


def row_type(kinds: str):
    """The numpy type of a row whose features have these types (b, h, i: whole numbers; d: doubles), a field per run."""
    import numpy as np
    return np.dtype([(f"f{a}", k, (b - a,)) for a, b, k in runs(kinds)])


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """A frame of (_y, _x) as blocks of some rows: _y the classes, _x the ``d`` features of each row, _k the types of the
    features, each the shortest that holds them exactly.  A pass hands a block to its task as it is, not number by number."""
    def part(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            if not len(y):
                continue
            whole, most = (x == np.rint(x)).all(axis=0), np.abs(x).max(axis=0)
            kinds = "".join("d" if not i or not m < 2 ** 31 else "b" if m < 2 ** 7 else "h" if m < 2 ** 15 else "i"
                            for i, m in zip(whole, most))
            packed = np.empty(len(y), row_type(kinds))
            for a, b, _ in runs(kinds):
                packed[f"f{a}"] = x[:, a:b]
            size = max(1, BLOCK_BYTES // max(1, packed.itemsize))
            cuts = range(0, len(y), size)
            yield pa.RecordBatch.from_arrays([pa.array([kinds] * len(cuts)),
                                              pa.array([y[a:a + size].tobytes() for a in cuts], pa.binary()),
                                              pa.array([packed[a:a + size].tobytes() for a in cuts], pa.binary())], ["_k", "_y", "_x"])

    return rows.select("_y", "_x").mapInArrow(part, "_k string, _y binary, _x binary")


def same_kinds(batch):
    """(types, classes, rows) of each run of blocks of the same types in an Arrow batch."""
    import numpy as np
    kinds, at = batch.column(0).to_pylist(), 0
    while at < len(kinds):
        end = at + 1
        while end < len(kinds) and kinds[end] == kinds[at]:
            end += 1
        yield kinds[at], numbers(batch.column(1)[at:end], np.int32), numbers(batch.column(2)[at:end], row_type(kinds[at]))
        at = end


def numbers(column, kind):
    """The numbers of all the blocks of an Arrow column, one behind another."""
    import numpy as np
    import pyarrow as pa
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:]
    if not len(column) or ends[len(column)] == ends[0]:
        return np.zeros(0, kind)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[len(column)]].view(kind)


def class_counts(packed: DataFrame) -> dict[int, int]:
    """class -> rows of it, in a frame of ``blocks``."""
    def part(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            y, n = np.unique(numbers(batch.column(0), np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(n.astype(np.int64))], ["y", "n"])

    found = summed(packed.select("_y").mapInArrow(part, "y int, n bigint"), "y", "n")
    return {r["y"]: r["n"] for r in found.collect()}  # at most one row per class


def sums(packed: DataFrame, scale, w, t, every: bool) -> Sums:
    """The sums over a frame of ``blocks`` whose features are multiplied by ``scale``."""
    import numpy as np

    def part(batches):
        import pyarrow as pa
        got = Sums(w, t, every)
        step = max(1, min(PAIRS // (len(t) if every else 2), NUMBERS // max(1, len(w))))
        for batch in batches:
            for kinds, y, rows in same_kinds(batch):
                for a in range(0, len(y), step):
                    some = rows[a:a + step]
                    x = np.empty((len(some), len(w)))
                    for i, j, _ in runs(kinds):
                        np.multiply(some[f"f{i}"], scale[i:j], out=x[:, i:j])
                    got.add(y[a:a + step], x)
        flat = got.flat()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["i", "s"])

    total = Sums(w, t, every)
    flat = np.zeros(len(total.flat()))
    parts = summed(packed.mapInArrow(part, "i bigint, s double"), "i", "s").toArrow()
    flat[parts.column("i").to_numpy()] = parts.column("s").to_numpy()
    return total.take(flat)


def _newton(rows: DataFrame, scale, n: int, start, d: int, reg: float, max_iter: int, every: bool, tol: float):
    """(weights, thresholds) by projected Newton steps from the thresholds ``start``."""
    import numpy as np
    k = len(start)
    spread = np.tril(np.ones((k, k)))  # thresholds = spread @ (first threshold, differences)
    u = np.concatenate([np.zeros(d), [start[0]], np.diff(start)])
    bounded = np.arange(d + k) > d     # the differences

    def at(u):
        s = sums(rows, scale, u[:d], spread @ u[d:], every)
        return s, s.loss / n + reg / 2 * float(u[:d] @ u[:d])

    s, loss = at(u)
    for _ in range(max_iter):
        g = np.concatenate([s.gw / n + reg * u[:d], spread.T @ s.gt / n])
        h = np.zeros((d + k, d + k))
        h[:d, :d] = s.hww / n + reg * np.eye(d)
        h[d:, :d] = spread.T @ s.hwt / n
        h[:d, d:] = h[d:, :d].T
        h[d:, d:] = spread.T @ (s.htt[:, None] * spread) / n
        free = ~(bounded & (u <= 0) & (g > 0))
        step = np.zeros(d + k)
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-9 * np.eye(free.sum()), g[free])
        size = 1.0
        while True:
            new = u - size * step
            new[bounded] = np.maximum(new[bounded], 0.0)
            s_new, lower = at(new)
            if lower < loss or size < 1e-4:
                break
            size /= 4
        if not lower < loss:
            break
        done = loss - lower < tol
        u, s, loss = new, s_new, lower
        if done:
            break
    return u[:d], spread @ u[d:], loss


def classes(df: DataFrame, n_ranks: int, bin_width: int) -> DataFrame:
    """Labelled rows with their class _y."""
    bounded = F.least(F.greatest(F.col(LABEL), F.lit(1)), F.lit(n_ranks))
    return df.where(F.col(LABEL).isNotNull()).withColumn("_y", F.ceil(bounded / F.lit(bin_width)).cast("int"))


def _blocks_of(prep, x: DataFrame, d: int) -> DataFrame:
    """Blocks of the classes and the features as they are, not yet scaled."""
    return blocks(prep.stages[0].transform(x).select("_y", vector_to_array("_shared").alias("_x")), d)


def _scale(prep):
    """What the fitted scaler multiplies each feature by."""
    import numpy as np
    std = prep.stages[1].std.toArray()
    return np.divide(1.0, std, out=np.zeros(len(std)), where=std != 0)


def ordinal_fit(train: DataFrame, cols: list[str], n_ranks: int, reg: float = 0.01, max_iter: int = 40,
                thresholds: str = "immediate", bin_width: int = 1, tol: float = 1e-7) -> dict:
    """Fit on the labelled rows; ranks may be binned (``bin_width``) into classes.  ``cols`` are numbers or vectors of numbers.

    ``theta`` holds the negative thresholds, as ``ordinal_predict`` adds them to the score.
    """
    import numpy as np
    if thresholds not in ("immediate", "all"):
        raise ValueError("thresholds must be 'immediate' or 'all'")
    x = classes(train, n_ranks, bin_width)
    if x.isEmpty():
        raise ValueError("no labelled row to learn from")
    prep = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_shared", handleInvalid="keep"),
                            StandardScaler(inputCol="_shared", outputCol="_sharedz", withMean=False, withStd=True)]).fit(x)
    d = prep.stages[1].std.size  # a column may be a vector of some features
    rows = cut_lineage(_blocks_of(prep, x, d))
    count = class_counts(rows)
    n, n_classes = sum(count.values()), -(-n_ranks // bin_width)
    below = np.cumsum([count.get(c, 0) for c in range(1, n_classes)])
    start = np.log((below + 0.5) / (n - below + 0.5))  # thresholds of the class shares alone
    w, t, loss = _newton(rows, _scale(prep), n, start, d, reg, max_iter, thresholds == "all", tol)
    return {"prep": prep, "w": w.tolist(), "theta": (-t).tolist(), "cols": cols, "bin_width": bin_width,
            "n_ranks": n_ranks, "loss": loss}


def ordinal_loss(fitted: dict, df: DataFrame, thresholds: str = "immediate") -> float:
    """Mean loss of labelled rows under a fitted model, without the penalty."""
    import numpy as np
    x = classes(df, fitted["n_ranks"], fitted["bin_width"])
    rows = _blocks_of(fitted["prep"], x, len(fitted["w"]))
    s = sums(rows, _scale(fitted["prep"]), np.array(fitted["w"]), -np.array(fitted["theta"]), thresholds == "all")
    return s.loss / x.count()


def thresholds_passed(margin: Column, theta: list[float]) -> Column:
    """How many of ``theta`` give a positive sum with the margin (0 without a margin).

    A sum does not fall as its threshold rises, so the falling thresholds up to a place are those passed and the
    place is found by halves.  The margin is one element of an array, so that a row evaluates it once, whatever
    expression it is, and not once per threshold.
    """
    if not theta:
        return F.lit(0)
    falling = F.array(*[F.lit(float(t)) for t in sorted(theta, key=lambda t: (t != t, t), reverse=True)])
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(theta).bit_length()))])

    def search(m):
        return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(falling, at + step - 1) + m > 0, at + step).otherwise(at))

    return F.get(F.transform(F.array(margin), search), F.lit(0))


def ordinal_predict(fitted: dict, df: DataFrame) -> DataFrame:
    """class = 1 + count(theta_k + w.x > 0) (theta has K-1 entries, bounded by the rank
    scale); with binning the prediction is the class's middle rank.  Without ``prep`` (given
    weights) the columns are taken as they are."""
    if fitted.get("prep") is None:
        x = df.withColumn("_z", F.array(*[F.col(c).cast("double") for c in fitted["cols"]]))
    else:
        x = fitted["prep"].transform(df).withColumn("_z", vector_to_array("_sharedz"))
    weights = F.array(*[F.lit(float(v)) for v in fitted["w"]])
    margin = F.aggregate(F.zip_with("_z", weights, lambda z, w: z * w), F.lit(0.0), lambda a, v: a + v)
    cls = F.lit(1) + thresholds_passed(F.col("_margin"), fitted["theta"])
    bw = fitted.get("bin_width", 1)
    pred = cls.cast("double") if bw == 1 else F.least(F.lit(float(fitted["n_ranks"])), (cls - 0.5) * bw)
    return x.withColumn("_margin", margin).withColumn("prediction", pred.cast("double")) \
            .drop("_shared", "_sharedz", "_z", "_margin")
