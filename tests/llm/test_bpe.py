import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from rankline.llm import bpe

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  x\t", "it's don't", "Ünï 漢字 😀", "a" * 5000, "ab" * 3000 + " " * 50, "<|endoftext|>",
         "\x00\x01   x", "123 4567 ½", "same text", "same text", " ".join(["word"] * 20000)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def row(enc, i, text):
    ids = enc.encode_ordinary(text or "")
    return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_whole_table_equals_tiktoken(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in bpe.op3_byte_bpe(spark, SF).collect())
    assert got == sorted(row(reference, r.doc_id, r.text) for r in docs)


def test_edge_rows(spark, make_docs, reference):
    docs = make_docs([(i // 2 or None, t) for i, t in enumerate(TEXTS)])
    got = sorted((tuple(r) for r in bpe.digest(docs, PATH, P.PATTERN).collect()), key=str)
    assert got == sorted((row(reference, i // 2 or None, t) for i, t in enumerate(TEXTS)), key=str)
    assert bpe.digest(make_docs([]), PATH, P.PATTERN).count() == 0
    # a column named like the output is replaced, unknown and NULL ids decode to nothing
    out = bpe.encode(docs.withColumn("IDS", docs.n_chars), PATH, P.PATTERN)
    assert dict(out.dtypes)["ids"] == "array<int>" and len(out.columns) == 6
    odd = spark.createDataFrame([([70, None, 10**9, 71],), (None,), ([],)], "ids array<int>")
    back = [r.decoded for r in bpe.decode(odd, PATH).collect()]
    token = {i: b for b, i in bpe.read_ranks(PATH).items()}
    assert [bytes(b) for b in back] == [token[70] + token[71], b"", b""]


def test_random_strings(reference):
    codec = bpe.ByteBPE(bpe.read_ranks(PATH), P.PATTERN)
    rnd = random.Random(5)
    for alphabet in ("ab", "aA \n", "é漢z0 ", "\x00 a'", "the and ing"):
        for _ in range(300):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
            assert codec.encode(text) == reference.encode_ordinary(text)


def test_compatibility_equals_merging():
    codec = bpe.ByteBPE(bpe.read_ranks(PATH), P.PATTERN)
    rnd, ids = random.Random(6), list(codec.length)
    for _ in range(5000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        assert codec.compatible(a, b) == (codec.merge(codec.text[a] + codec.text[b]) == [a, b])
