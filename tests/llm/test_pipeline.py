import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken

from rankline.llm import bpe, line_dedup, mixing, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
        assert name == cp.STAGES[-1][0] or steps[-1].columns == columns
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, p in scores.items() if not p} and 0 < steps[1].count() < n
    # lines: all documents stay, and a second pass finds nothing
    assert steps[2].count() == steps[1].count()
    assert line_dedup.later_copies(steps[2], across_blank=True).count() == 0
    # one row of each component, its smallest id
    low = {r.component_id for r in simhash.components_of(steps[2]).collect()}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(low)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(steps[3]).collect()}
    taken = {}
    for r in steps[4].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {i: c for i, c in plan.items() if c}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(cp.VOCABULARY)), special_tokens={})
    text = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        assert r.round_trip and r.ids == enc.encode_ordinary(text[r.doc_id])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    line = " ".join(f"word{i} stands here" for i in range(30)) + "."
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line), (4, line), (None, line + " more"), (5, line + "\nand an ending of its own"),
            (6, "x" * 200_000), (7, "unlike all the others this one goes " * 3000), (8, "漢字 é 😀 \x00 plain words at the end")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 3 else None, None, k, "kept") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, copies int, _row string")
    columns, steps = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], str(tmp_path)).cache())
        assert steps[-1].columns == columns, name
    assert steps[1].count() == steps[2].count() == len(rows)  # nothing is toxic, line dedup drops no row
    # the second line of 5 stays; of the copies and of the texts without a word one each
    assert {r.text for r in steps[2].where("doc_id = 5").collect()} == {"and an ending of its own"}
    assert steps[3].where("doc_id = 4").count() <= 1 and steps[3].where("doc_id in (1, 2, 3)").count() == 1
    assert steps[4].where("doc_id in (1, 2, 3)").count() <= 2  # of size 0: it counts for no target
    last = cp.STAGES[-1][1](spark, steps[4], str(tmp_path)).collect()
    assert len(last) == steps[4].count() and all(r.round_trip for r in last)
