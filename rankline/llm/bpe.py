"""Byte-level BPE encoding and decoding.

Each match of the pre-tokeniser pattern is encoded on its own.  Its UTF-8 bytes are mapped
to Latin-1 characters so that a pyahocorasick trie of the vocabulary can tell, at every byte the
walk comes to, the longest token that starts there.  Encoding walks left to right with the
longest match; a token is accepted only if it is *compatible* with the token before
it, that is, if merging the two tokens' bytes by rank gives back exactly these two tokens.
A rejected token is replaced by its next shorter prefix token, and when none is left the
walk backtracks over the previous token and never enters that byte again.  A sequence whose
adjacent tokens are all compatible is the result of the merges, so the walk reproduces them
exactly; every byte is entered at most once and abandoned at most once, and compatibility is
memoised per pair, so the work is linear in the bytes.

Plan: both directions are row-local Arrow functions (no shuffle); ``round_trip`` is one function for
both, so that the ids it decodes do not travel and texts are encoded once.  The rank file is read on
the driver and broadcast (a vocabulary is of fixed size, about 1 MB); every Python worker
builds the trie once.

Defined results: a NULL or empty text has no ids and decodes to empty; ids that the
vocabulary lacks, and NULL ids, decode to nothing; a column that already has the name of the
output is replaced; all other columns and all rows, repeated ones included, pass through.  An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import fresh, table
from rankline.llm.registry import register

# Entries a worker keeps of each memo (a bound on memory only).
PIECE_MEMO = 240_000
PAIR_MEMO = 150_000
# Longer pieces are encoded each time: long runs hardly repeat and would fill the memo.
MEMO_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for one vocabulary; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.by_text = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.text = {i: t for t, i in self.by_text.items()}
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for text, i in self.by_text.items():
            # tokens that the merges never produce cannot stand in a result
            halves = self.merge(text, i) if len(text) > 1 else []
            if len(text) == 1 or len(halves) == 2:
                if halves:
                    self.halves[i] = (halves[0], halves[1])
                self.automaton.add_word(text, (len(text), i))
                self.length[i] = len(text)
        self.trie_path = self.automaton.longest_prefix
        self.longest_token = max(self.length.values())
        # longest token of every path of the trie met so far (at most the trie's nodes)
        self.at_path: dict[str, int] = {}
        self.shorter = {i: self._prefix(self.token[i].decode("latin-1")) for i in self.length}
        self.pair: dict[int, bool] = {}
        self.memo = _Memo(self.piece)

    def _prefix(self, text: str) -> int | None:
        for n in range(len(text) - 1, 0, -1):
            i = self.by_text.get(text[:n])
            if i is not None and i in self.length:
                return i
        return None

    def merge(self, text: str, stop: int | None = None) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals; for short strings only.

        With ``stop``, end before the merge that would make this token of the whole text.
        """
        parts, ranks = list(text), self.by_text
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or (best == stop and len(parts) == 2):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) >= PAIR_MEMO:
                self.pair.clear()
            ok = self.pair[key] = self._stay_apart(a, b)
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens leaves the border between them.

        Undo the merges inside both tokens, the latest first.  The pieces that touch the
        border at each moment would have merged across it if their union has a rank below
        that of the merge undone last (ties go to the left).
        """
        text, halves, ranks = self.text, self.halves, self.by_text
        limit = len(ranks) + 1
        while True:
            across = ranks.get(text[a] + text[b])
            if across is not None and across < limit:
                return False
            if a > b and a in halves or b not in halves:
                if a not in halves:
                    return True
                limit, a = a, halves[a][1]
            else:
                limit, b = b + 1, halves[b][0]

    def longest(self, text: str, pos: int) -> int:
        """The longest token that starts at ``pos``."""
        ahead = text[pos:pos + self.longest_token]
        path = ahead[:self.trie_path(ahead)]
        i = self.at_path.get(path)
        if i is None:
            whole = self.by_text.get(path)
            i = whole if whole in self.length else self._prefix(path)
            if i is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            self.at_path[path] = i
        return i

    def walk(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        n = len(text)
        length, shorter, known, compatible, longest = self.length, self.shorter, self.pair.get, self.compatible, self.longest
        i = longest(text, 0)
        out = [i]
        last, pos, dead = i, length[i], None
        if pos == n:
            return out
        i = longest(text, pos)
        while True:
            while i is not None:
                end = pos + length[i]
                if dead is None or end not in dead:
                    ok = known(last << 32 | i)
                    if ok or ok is None and compatible(last, i):
                        break
                i = shorter[i]
            else:
                # no token may follow ``last`` here: give this position up, shorten ``last``
                if dead is None:
                    dead = set()
                dead.add(pos)
                while True:
                    i = out.pop()
                    pos -= length[i]
                    i = shorter[i]
                    if out:
                        last = out[-1]
                        break
                    while i is not None and length[i] in dead:
                        i = shorter[i]
                    if i is None:
                        raise ValueError("the vocabulary lacks a byte of the text")
                    out.append(i)
                    last, pos = i, length[i]
                    i = longest(text, pos)
                    break
                continue
            out.append(i)
            if end == n:
                return out
            last, pos = i, end
            i = longest(text, pos)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, as 32-bit integers one after another."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return array("i", (whole,) if whole is not None else self.walk(raw.decode("latin-1"))).tobytes()

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class _Memo(dict):
    """Pieces met lately and their packed ids.  When full, it becomes the older generation,
    from which pieces that come up again move back."""

    def __init__(self, piece):
        super().__init__()
        self.piece, self.older = piece, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None) or self.piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= PIECE_MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


# The codec that this Python worker has built, by rank file and pattern.
_BUILT: dict[tuple[str, str], ByteBPE] = {}
_TOKENS: dict = {}


def _codec(ranks, pattern: str) -> ByteBPE:
    """The worker's codec for a broadcast vocabulary."""
    path, table_ = ranks.value
    if (path, pattern) not in _BUILT:
        _BUILT.clear()
        _BUILT[path, pattern] = ByteBPE(table_, pattern)
    return _BUILT[path, pattern]


def _encoded(texts, ranks, pattern: str):
    """Ids of an Arrow array of texts: (flat ids, ends of the rows)."""
    import numpy as np
    codec = _codec(ranks, pattern)
    packed = [codec.packed(t.as_py()) for t in texts]
    return np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int64)


def _decoded(flat, ends, ranks):
    """The bytes of rows of ids; ids that the vocabulary lacks stand for nothing."""
    import numpy as np
    import pyarrow as pa
    path, table_ = ranks.value
    if path not in _TOKENS:
        # bytes by id; the entry after the last id is empty and stands for unknown ids
        by_id = dict(zip(table_.values(), table_))
        _TOKENS[path] = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 2)], pa.large_binary())
    tokens = _TOKENS[path]
    known = np.where((flat < 0) | (flat >= len(tokens)), len(tokens) - 1, flat)
    parts = tokens.take(pa.array(known))
    at = np.frombuffer(parts.buffers()[1], np.int64)[:len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = parts.buffers()[2] if len(flat) else None
    rows = pa.py_buffer(at[ends].tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, rows, data or pa.py_buffer(b"")]).cast(pa.binary())


def _vocabulary(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>): the BPE ids of the whole ``text``, without special tokens."""
    ranks = _vocabulary(df, ranks_path)

    @F.arrow_udf("array<int>")
    def run(texts):
        import pyarrow as pa
        flat, ends = _encoded(texts, ranks, pattern)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that ``ids`` stand for."""
    ranks = _vocabulary(df, ranks_path)

    @F.arrow_udf("binary")
    def run(lists):
        import numpy as np
        import pyarrow as pa
        counts = np.array([len(x.values) if x.is_valid else 0 for x in lists], np.int64)
        flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return _decoded(flat, np.concatenate([[0], np.cumsum(counts)]), ranks)

    return df.withColumn(decoded, run(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one function."""
    ranks = _vocabulary(df, ranks_path)

    @F.arrow_udf("struct<ids array<int>, decoded binary>")
    def run(texts):
        import pyarrow as pa
        flat, ends = _encoded(texts, ranks, pattern)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([lists, _decoded(flat, ends, ranks)], ["ids", "decoded"])

    c = fresh(df, "_coded")
    return df.withColumn(c, run(F.col(text))).withColumns({ids: F.col(f"{c}.ids"), decoded: F.col(f"{c}.decoded")}).drop(c)


def digest(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    both = round_trip(df.select("doc_id", "text"), ranks_path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digest(table(spark, sf_dir, "documents"),
                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
