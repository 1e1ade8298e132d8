"""Vector code compression: product codes of integer vectors, nearest entries found by a GNAT.

A vector's components become integers, floor(``SCALE`` * x); the vector is cut into equal parts and
each part is coded by the nearest entry of that part position's codebook.  Codebooks start from the
vectors of the smallest ids and are improved by whole-number Lloyd rounds, so every engine and every
partitioning gets the same ones.

The nearest entry is found in a geometric near-neighbour access tree.  A node holds up to
``DEGREE`` split points, picked far from each other; every other entry belongs to the nearest split point and
goes on into that one's child.  For every split point s and child c the node stores the range of
distances between s and all points of c, its own split point included.  After the distance from a query
to s is known, every child whose range lies wholly nearer or wholly farther than that distance by *more*
than the best distance so far is left out as a whole, its split point included.  Distances are rounded
conservatively (down or up to whole numbers, whichever eliminates less) and the comparison is
strict, so an entry at exactly the best distance is never left out: such ties are settled by comparing
squared whole-number distances, then indices.  A batch of parts goes down the tree together.

Plan: one pass over the table a round (column-pruned, nothing shuffled but partial sums: a task
makes one row per part, entry and component), then one pass for the codes.  The driver holds the
codebooks alone: ``entries`` times the dimension integers, whatever the number of rows.

Defined results: rows whose vector is NULL or has a NULL or non-finite component are dropped.  The
dimension is that of the first vector in the order of ids; its parts must be equal, or ValueError is
raised.  Vectors of another dimension, or with a component beyond ``LARGEST`` after scaling (sums
would not be exact), have a NULL code and error and teach nothing.  With fewer vectors than entries
the codebooks have as many entries as there are vectors; rows of equal ids are taken in the order of
their vectors, NULL ids last.  Repeated rows are all coded, alike.  An empty table gives an
empty result.  Other columns pass through ``compress``; columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, table
from rankline.llm.registry import register
from rankline.session import cut_lineage

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
DEGREE = 4
LARGEST = 1 << 26


def floor_root(x):
    """Largest whole numbers whose squares are at most ``x`` (int64 array)."""
    import numpy as np
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r += (r + 1) * (r + 1) <= x
    return r


def ceil_root(x):
    """Smallest whole numbers whose squares are at least ``x``."""
    r = floor_root(x)
    return r + (r * r < x)


def squared(points, point):
    """Squared distances from the rows of ``points`` to ``point``."""
    import numpy as np
    delta = points - point
    return np.einsum("ij,ij->i", delta, delta)


class Gnat:
    """A tree over the rows of ``points`` (int64); ``ids`` are their numbers."""

    def __init__(self, points, ids=None):
        import numpy as np
        ids = np.arange(len(points)) if ids is None else ids
        # split points: the first, then always the one farthest from those taken
        taken, far = [0], squared(points, points[0])
        while len(taken) < min(DEGREE, len(ids)):
            rest = far.copy()
            rest[taken] = -1
            taken.append(int(rest.argmax()))
            far = np.minimum(far, squared(points, points[taken[-1]]))
        self.splits, self.ids = points[taken], ids[taken]
        to_split = np.stack([squared(points, s) for s in self.splits])
        of = to_split.argmin(axis=0)
        of[taken] = np.arange(len(taken))
        # ranges[i][j]: least and greatest distance from split point i to the points of child j
        self.ranges = [[(int(floor_root(d[of == j]).min()), int(ceil_root(d[of == j]).max())) for j in range(len(taken))]
                       for d in to_split]
        inner = np.ones(len(ids), bool)
        inner[taken] = False
        self.children = [Gnat(points[m], ids[m]) if (m := inner & (of == j)).any() else None for j in range(len(taken))]

    def search(self, queries, rows, best, index, counted=None):
        """Lowers ``best`` (squared distances) and ``index`` of the queries numbered ``rows``; ``counted``
        gets the number of distances taken for each query."""
        import numpy as np
        alive = np.ones((len(self.ids), len(rows)), bool)
        for i, (point, number) in enumerate(zip(self.splits, self.ids)):
            here = np.flatnonzero(alive[i])
            at = rows[here]
            d = squared(queries[at], point)
            if counted is not None:
                counted[at] += 1
            better = (d < best[at]) | ((d == best[at]) & (number < index[at]))
            best[at[better]], index[at[better]] = d[better], number
            low, high, radius = floor_root(d), ceil_root(d), ceil_root(best[at])
            for j, (least, greatest) in enumerate(self.ranges[i]):
                if j != i:
                    alive[j, here[(low - greatest > radius) | (least - high > radius)]] = False
            # the child of the split point itself: only from the outside
            alive[i, here[low - self.ranges[i][i][1] > radius]] = False
        for j, child in enumerate(self.children):
            if child is not None and alive[j].any():
                child.search(queries, rows[alive[j]], best, index, counted)

    def nearest(self, queries, counted=None):
        """(index, squared distance) of the nearest point of every query; ties to the lower index."""
        import numpy as np
        best = np.full(len(queries), np.iinfo(np.int64).max >> 2)
        index = np.full(len(queries), np.iinfo(np.int64).max)
        self.search(queries, np.arange(len(queries)), best, index, counted)
        return index, best


def whole_vectors(vectors, dimension: int, scale: int):
    """(integers of the rows that can be coded, their row numbers) of an Arrow list array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    fits = np.flatnonzero(pc.equal(pc.list_value_length(vectors), dimension).fill_null(False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale).reshape(len(fits), dimension)
    exact = (np.abs(x) <= LARGEST).all(axis=1)
    return x[exact].astype(np.int64), fits[exact]


def _kept(df: DataFrame, vector: str) -> DataFrame:
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.where(F.coalesce(finite, F.lit(False)))


def start(kept: DataFrame, vector: str, vec_id: str, parts: int, entries: int, scale: int):
    """The first codebooks, an integer array of (part, entry, component); None without a vector to code."""
    import numpy as np
    order = [F.col(vec_id).asc_nulls_last(), F.col(vector)]
    first = kept.select(F.size(vector)).orderBy(*order).first()
    if first is None:
        return None
    dimension = first[0]
    if dimension % parts:
        raise ValueError(f"{dimension} components are not {parts} equal parts")
    exact = F.forall(F.col(vector), lambda x: F.abs(F.floor(x.cast("double") * scale)) <= LARGEST)
    rows = kept.where((F.size(vector) == dimension) & exact).select(F.col(vector).alias("v")).orderBy(*order).limit(entries).collect()
    if not rows:
        return None
    x = np.floor(np.array([r.v for r in rows], np.float64).reshape(len(rows), dimension) * scale).astype(np.int64)
    return x.reshape(len(x), parts, dimension // parts).transpose(1, 0, 2)


def better_codebooks(kept: DataFrame, vector: str, books, scale: int):
    """One round: the codebooks after every part moved its nearest entry."""
    import numpy as np
    parts, entries, width = books.shape

    def sums(batches):
        import pyarrow as pa
        trees = [Gnat(b) for b in books]
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last column counts
        for batch in batches:
            x, _ = whole_vectors(batch.column(0), parts * width, scale)
            x = x.reshape(len(x), parts, width)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, p])
                total[p, :, width] += np.bincount(index, minlength=entries)
                for k in range(width):  # a batch's sums stay below 2^53
                    total[p, :, k] += np.bincount(index, x[:, p, k], entries).astype(np.int64)
        p, e, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, k, total[p, e, k])], ["p", "e", "k", "s"])

    got = (kept.select(vector).mapInArrow(sums, "p bigint, e bigint, k bigint, s bigint")
           .groupBy("p", "e", "k").agg(F.sum("s").alias("s")).collect())
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in got:
        total[r.p, r.e, r.k] = r.s
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def codes(vector: Column, books, scale: int) -> Column:
    """struct<code, error> of vectors: hex digits of the nearest entries, sum of their squared distances."""
    parts, _, width = books.shape

    def run(vectors):
        import numpy as np
        import pyarrow as pa
        x, rows = whole_vectors(vectors, parts * width, scale)
        x = x.reshape(len(x), parts, width)
        found = [Gnat(b).nearest(x[:, p]) for p, b in enumerate(books)]
        error = np.full(len(vectors), -1)
        error[rows] = np.sum([d for _, d in found], axis=0)
        digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
        code: list[str | None] = [None] * len(vectors)
        for r, d in zip(rows.tolist(), digits):
            code[r] = d.tobytes().hex()
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(error, mask=error < 0)], ["code", "error"])

    return F.arrow_udf(run, "struct<code string, error bigint>")(vector)


def compress(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, object]:
    """(rows that have a finite vector with their code and error, the codebooks or None)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code digit pair names 1 to 256 entries")
    kept = _kept(df, vector)
    books = start(kept, vector, vec_id, parts, entries, scale)
    if books is None:
        return kept.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("bigint")}), None
    for _ in range(rounds):
        books = better_codebooks(kept, vector, books, scale)
    c = fresh(df, "_coded")
    coded = kept.withColumn(c, codes(F.col(vector), books, scale))
    return coded.withColumns({"code": F.col(f"{c}.code"), "error": F.col(f"{c}.error")}).drop(c), books


def codebooks_digest(books) -> str:
    """SHA-256 of the entries' components by part, entry and position."""
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add label_error: the errors of all rows of the same label summed up, NULL labels together."""
    of = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(of, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def _oracle() -> str:
    out = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, ps AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x
  FROM kept, range({PARTS}) AS r(p))
, b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM ps
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""]
    near = """
, a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x,
         min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * 256 + e) AS m
  FROM ps JOIN b{r} USING (p) GROUP BY vec_id, p)"""
    for r in range(ROUNDS):
        out.append(near.format(r=r) + f"""
, s{r} AS (SELECT p, e, k, sum(y) AS s, count(*) AS n FROM (
    SELECT p, CAST(m % 256 AS BIGINT) AS e, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{r}) GROUP BY p, e, k)
, b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM s{r} GROUP BY p, e) u USING (p, e))""")
    out.append(near.format(r=ROUNDS) + f"""
, f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m % 256 AS BIGINT)), '' ORDER BY p) AS code,
               CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
, d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, d""")
    return "".join(out)


@register("op12_vector_codes", _oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and label errors of all vectors, and the digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = cut_lineage(coded.select("vec_id", "label", "code", "error"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error",
                                          F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
