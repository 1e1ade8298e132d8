"""Language-model scores by stupid backoff, from n-gram counts over the whole corpus.

The score of a word after its context is count(context + word) / count(context) if that n-gram
occurs, else ``ALPHA`` times the score after a context shorter by one word; a word without a
context is scored by its share of all words, and a word that occurs nowhere else as one
``ALPHA``-th of a single occurrence.  A document's score is the sum of the logarithms.  Counts
are those of all *other* documents: a document's own occurrences are taken off the corpus
counts, so a text does not vouch for itself.

The relations and their joins, packed so that n-grams travel as sorted arrays:

1. *Chunks.*  The scan packs documents into chunks of about ``CHUNK_BYTES`` of text, one row
   each, written to the shared folder.
2. *N-grams of a chunk*, of all orders, as distinct hashes with counts, cut by their leading
   bits into ``buckets`` arrays, which are shuffled by bucket.
3. *Count table.*  Each bucket of the hash space adds up its counts and answers every chunk
   with the corpus counts of the n-grams that the chunk has.  An n-gram costs one entry per
   chunk, however often it occurs, so frequent ones make no bucket large; the number of buckets
   grows with the number of words.
4. *Scores.*  The answers join their chunk, whose n-grams are hashed again, document counts are
   taken off, and the logarithms are summed per document.

N-grams are told apart by 48 + log2(buckets) bits of hash: up to some 4 x 10^8 distinct n-grams with 256
buckets no two are likely to share a hash, beyond that single counts may be too high by another's.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, case kept; NULL and empty texts have no words
and score 0; repeated rows are documents of their own; the only document of a corpus has no
counts to be scored by, so all its words are unseen; other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import table
from rankline.llm.registry import register
from rankline.session import cut_lineage

ORDER = 3
ALPHA = 0.4
CHUNK_BYTES = 7 << 20
BUCKET_BYTES = 16 << 20
SUFFIX = 6  # bytes of a hash kept inside its bucket


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, n_words, docs): documents in compressed Arrow streams of about ``chunk_bytes``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def pack():
            body = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
            sink = pa.BufferOutputStream()
            strong = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))  # written and shuffled
            with pa.ipc.new_stream(sink, body.schema, options=strong) as out:
                out.write_batch(body)
            words = sum(len(t.encode().split()) for t in texts)
            return pa.record_batch([pa.array([task << 32 | number]), pa.array([words]),
                                    pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_words", "docs"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1]) + 64
                if size >= chunk_bytes:
                    yield pack()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pack()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk long, n_words long, docs binary")


def _mix(a, b):
    """Hash of a pair of 64-bit hashes (multiply, rotate, xor-shift)."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(blob: bytes, order: int, bits: int):
    """(doc ids, words per doc, [hashes of the n-grams that end at each word, per order], [their words' positions])."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest
    with pa.ipc.open_stream(blob) as stream:
        body = stream.read_all()
    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for t in body.column("text"):
        words = t.as_py().encode().split()
        sizes.append(len(words))
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    own = np.fromiter((xxh64_intdigest(w, 42) for w in number), np.uint64, len(number))
    words = own[np.concatenate(parts)] if number else own
    sizes = np.array(sizes, np.int64)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # words before it in the document
    grams, at, last = [], [], words
    for n in range(order):
        ends = np.flatnonzero(inside >= n)
        if n:
            whole = np.zeros(len(words), np.uint64)
            whole[ends] = _mix(last[ends - 1], words[ends])
            last = whole
        # the order takes part in the hash: equal hashes mean equal n-grams
        grams.append(_mix(last[ends], np.full(len(ends), n + 1, np.uint64)) >> np.uint64(64 - bits))
        at.append(ends)
    return body.column("doc_id"), sizes, grams, at


def _squeeze(planes) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _pack(values, width: int) -> bytes:
    """Integers as ``width`` byte planes, compressed."""
    import numpy as np
    return _squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def _unpack(blob: bytes, width: int):
    import numpy as np
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8")


def _grams_of_chunks(packed: DataFrame, order: int, bits: int, buckets: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for chunk, blob in zip(batch.column(0), batch.column(1)):
                _, _, grams, _ = _hashes(blob.as_buffer(), order, bits)
                found, count = np.unique(np.concatenate(grams), return_counts=True)
                bucket = (found >> np.uint64(8 * SUFFIX)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                names, keys, counts = [], [], []
                for b in np.flatnonzero(np.diff(cut)):
                    part = found[cut[b]:cut[b + 1]]
                    keys.append(_pack(np.diff(part, prepend=np.uint64(int(b) << (8 * SUFFIX))), SUFFIX))
                    counts.append(_pack(count[cut[b]:cut[b + 1]], 4))
                    names.append(int(b))
                yield pa.record_batch([pa.array([chunk.as_py()] * len(names), pa.int64()), pa.array(names, pa.int32()),
                                       pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                                      ["chunk", "bucket", "keys", "counts"])

    return packed.select("chunk", "docs").mapInArrow(run, "chunk long, bucket int, keys binary, counts binary")


def _count_bucket(rows):
    """Corpus counts of one bucket, answered to every chunk in the order of its keys."""
    import numpy as np
    import pyarrow as pa
    keys = [np.cumsum(_unpack(k.as_buffer(), SUFFIX)) for k in rows.column("keys")]
    counts = np.concatenate([_unpack(c.as_buffer(), 4) for c in rows.column("counts")])
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    ordered = whole[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(counts[order], starts)
    answer = np.empty(len(whole), np.uint64)
    answer[order] = np.repeat(total, np.diff(np.append(starts, len(whole))))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"),
                     "totals": pa.array([_pack(a, 6) for a in np.split(answer, cuts)], pa.binary())})


RESULT = "doc_id long, n_words long, log_score double, n_by_order array<long>, n_unseen long"


def _score_chunks(packed: DataFrame, totals: DataFrame, order: int, bits: int, alpha: float, corpus: int) -> DataFrame:
    def run(docs, answers):
        import numpy as np
        import pyarrow as pa
        ids, sizes, grams, at = _hashes(docs.column("docs")[0].as_buffer(), order, bits)
        nd, n = len(sizes), int(sizes.sum())
        of = np.repeat(np.arange(nd, dtype=np.int32), sizes)
        if n:
            answers = answers.sort_by("bucket")
            total = np.concatenate([_unpack(a.as_buffer(), 6) for a in answers.column("totals")]).astype(np.int64)
            flat = np.concatenate(grams)
            del answers, grams
            # a stable sort keeps documents in order among equal n-grams
            by = np.argsort(flat, kind="stable")
            flat = flat[by]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            del flat
            doc = np.concatenate([of[a] for a in at])[by]
            new_doc = new | np.concatenate([[True], doc[1:] != doc[:-1]])
            del doc
            own = np.diff(np.append(np.flatnonzero(new_doc), len(by)))
            counts = total[np.cumsum(new) - 1]
            counts -= own[np.cumsum(new_doc) - 1]
            others = np.empty(len(by), np.int64)
            others[by] = counts
            del by, new, new_doc, own, counts, total
        words = np.maximum(1, corpus - sizes)
        log = np.zeros(n)
        level = np.zeros(n, np.int8)  # order that scored the word, 0: unseen
        have = np.zeros(n, np.int8)   # longest order that fits into the document
        before = words[of].astype(float)
        start = 0
        for k, ends in enumerate(at):
            have[ends] = k + 1
            count = np.zeros(n, np.int64)
            if n:
                count[ends] = others[start:start + len(ends)]
            start += len(ends)
            seen = count > 0
            log[seen] = np.log(count[seen] / before[seen])
            level[seen] = k + 1
            before = np.ones(n)
            before[1:] = count[:-1]
        log[level == 0] = np.log(alpha) - np.log(words[of][level == 0])
        log += np.log(alpha) * np.where(level == 0, have - 1, have - level)
        by_order = np.stack([np.bincount(of, level == k, nd) for k in range(order + 1)]).astype(np.int64)
        return pa.table({"doc_id": ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids,
                         "n_words": pa.array(sizes), "log_score": pa.array(np.bincount(of, log, nd).astype(float)),
                         "n_by_order": pa.array(by_order[1:].T.tolist(), pa.list_(pa.int64())),
                         "n_unseen": pa.array(by_order[0])})

    return packed.select("chunk", "docs").groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, RESULT)


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, log_score, words scored at each order, words seen in no other document."""
    packed = cut_lineage(chunks(docs, chunk_bytes))
    corpus = packed.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 << max(8, (corpus * order * (SUFFIX + 2) // bucket_bytes).bit_length())
    bits = min(64, 8 * SUFFIX + buckets.bit_length() - 1)
    grams = _grams_of_chunks(packed, order, bits, buckets)
    totals = grams.groupBy("bucket").applyInArrow(_count_bucket, "chunk long, bucket int, totals binary")
    return _score_chunks(packed, totals, order, bits, alpha, corpus)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT r, n, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2,
             CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM t),
c AS (SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS c1,
             CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) ELSE 0 END AS c2,
             CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) ELSE 0 END AS c3,
             greatest(1, (SELECT count(*) FROM t) - n) AS rest FROM g),
x AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS b2 FROM c),
s AS (SELECT r, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level, least(i, 3) AS have,
             CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) WHEN c1 > 0 THEN ln(c1 / rest)
                  ELSE ln(0.4::DOUBLE) - ln(rest) END AS l FROM x)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words,
       round(coalesce(sum(l + ln(0.4::DOUBLE) * CASE level WHEN 0 THEN have - 1 ELSE have - level END), 0), 6) AS log_score,
       count(*) FILTER (level = 1) AS n_words_1, count(*) FILTER (level = 2) AS n_words_2, count(*) FILTER (level = 3) AS n_words_3,
       count(*) FILTER (level = 0) AS n_unseen
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id
"""


@register("op2_lm_score", SQL)
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"),
                      *[F.col("n_by_order")[i].alias(f"n_words_{i + 1}") for i in range(ORDER)], "n_unseen")
