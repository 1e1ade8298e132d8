"""The table with a commit log: what an insert reads, half-written appends, replays, two writers."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from rankline.schema import KEY, RANKINGS
from rankline.sources import ingest as I
from rankline.sources import store as S
from rankline.sources.fixtures import view
from testdata import SF_SMALL


def rows(spark, keys, rank=1):
    """Table rows from (subject, day or None, model)."""
    at = lambda d: None if d is None else dt.datetime(2022, 3, 1) + dt.timedelta(days=d)
    return spark.createDataFrame([(s, rank, *(["A"] + [None] * 16), at(d), m is None, m) for s, d, m in keys], RANKINGS)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def table(spark, tmp_path):
    S.create_if_absent(spark, f"{tmp_path}/t", buckets=2)
    return f"{tmp_path}/t"


def test_insert_equals_the_plain_form_and_reads_back(spark, table):
    old, multi = view(spark, SF_SMALL, "rankings"), view(spark, SF_SMALL, "rankings_multi").select(*RANKINGS.fieldNames())
    assert S.insert(spark, table, old) == old.count()
    add = I.rows_to_insert(old, multi)
    assert S.insert(spark, table, multi) == add.count()
    assert same(S.read(spark, table), old.unionByName(add))
    assert S.insert(spark, table, multi) == 0
    assert same(S.read(spark, table, version=1), old)  # the table as it was after a commit


def test_sqlite_keys_and_null_keys(spark, table):
    new = rows(spark, [(1, 0, None), (1, 0, "m"), (None, 0, "m"), (2, None, "m")])
    assert S.insert(spark, table, new) == 4 and S.insert(spark, table, new) == 0
    assert S.insert(spark, table, new, null_safe=False) == 3  # only the key without a NULL is found
    # by its batch id a replay is told all the same
    assert S.insert(spark, table, new, null_safe=False, batch_id="b1") == 3
    assert S.insert(spark, table, new, null_safe=False, batch_id="b1") == 0
    assert S.read(spark, table).count() == 10


def test_rows_read_grow_with_the_batch_not_the_table(spark, table, monkeypatch):
    S.insert(spark, table, rows(spark, [(s, d, None) for s in range(40) for d in range(25)]))
    opened = []
    real = S.read_files
    monkeypatch.setattr(S, "read_files", lambda sp, p, files, *a: opened.append(files.collect()) or real(sp, p, files, *a))
    assert S.insert(spark, table, rows(spark, [(3, 4, None), (3, 4, "m"), (99, 4, None)])) == 2
    assert all("_slice=2022-03-05" in r.file for r in opened[-1]) and len(opened[-1]) <= 2
    S.insert(spark, table, rows(spark, [(3, 40, None)]))  # a new day meets no file
    assert len(opened) == 1
    # the log is filtered by commit before it is read, files are met by slice and bucket
    plan = S.log(spark, table).where(F.col("commit") > 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(commit" in plan
    files = S.meeting(S.files_of(spark, table), S.placed(rows(spark, [(3, 4, None)]), S.layout(spark, table)))
    read = S.read_files(spark, table, files).select(*KEY)
    assert len(read.inputFiles()) <= 2 and "Rank" not in str(read._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1])


def test_a_killed_append_is_no_part_of_the_table_and_a_replay_mends_it(spark, table, monkeypatch):
    first = rows(spark, [(s, 0, None) for s in range(20)])
    S.insert(spark, table, first, batch_id="0")

    def killed(*a):
        raise RuntimeError("killed")

    batch = rows(spark, [(s, d, None) for s in range(10, 30) for d in (0, 1)])
    for step in ("_stage", "commit"):
        real = getattr(S, step)
        # killed after the data files are written, or before the commit's renaming
        monkeypatch.setattr(S, step, (lambda *a: real(*a) and None or killed()) if step == "_stage" else killed)
        with pytest.raises(RuntimeError):
            S.insert(spark, table, batch, batch_id="1")
        monkeypatch.setattr(S, step, real)
        assert same(S.read(spark, table), first)
    assert S.unlisted(spark, table).count() > 0
    assert S.insert(spark, table, batch, batch_id="1") == 30
    assert S.insert(spark, table, batch, batch_id="1") == 0
    assert S.read(spark, table).groupBy(*KEY).count().where("count > 1").count() == 0
    assert S.read(spark, table).count() == 50


def test_a_writer_that_comes_second_checks_the_files_committed_meanwhile(spark, table, monkeypatch):
    S.insert(spark, table, rows(spark, [(1, 0, None)]))
    mine, theirs = rows(spark, [(s, 1, None) for s in range(6)], 5), rows(spark, [(s, 1, None) for s in range(3, 9)], 7)
    real, done = S.commit, []

    def late(sp, path, number, entries):
        if not done:  # the other writer commits between this one's check and its own commit
            done.append(1)
            assert S.insert(spark, table, theirs) == 6
        return real(sp, path, number, entries)

    monkeypatch.setattr(S, "commit", late)
    assert S.insert(spark, table, mine) == 3
    got = {r.SubjectID: r.Rank for r in S.read(spark, table).where("UpdateDT >= '2022-03-02'").collect()}
    assert got == {0: 5, 1: 5, 2: 5, **{s: 7 for s in range(3, 9)}}
    # one that meets no new file keeps what it has written
    done.clear()
    other = rows(spark, [(s, 9, None) for s in range(4)])
    theirs = rows(spark, [(s, 3, None) for s in range(6)])
    assert S.insert(spark, table, other) == 4 and S.read(spark, table).count() == 20


def test_two_writers_of_the_same_keys_at_once(spark, table):
    counts = []
    new = [rows(spark, [(s, d, None) for s in range(8) for d in range(3)], rank) for rank in (1, 2)]
    threads = [threading.Thread(target=lambda n=n: counts.append(S.insert(spark, table, n))) for n in new]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(counts) == 24 and S.read(spark, table).count() == 24
    assert S.read(spark, table).select(*KEY).distinct().count() == 24


def test_layout_is_fixed_at_creation_and_empty_batches(spark, table):
    S.create_if_absent(spark, table, period="month", buckets=9)
    assert S.layout(spark, table) == ("day", 2)
    assert S.read(spark, table).count() == 0 and S.read(spark, table).columns == RANKINGS.fieldNames()
    empty = rows(spark, [])
    assert S.insert(spark, table, empty) == 0 and S.head(spark, table) == 0
    assert S.insert(spark, table, empty, batch_id="x") == 0 and S.head(spark, table) == 1
    with pytest.raises(ValueError):
        S.create_if_absent(spark, table + "2", period="hour")


def test_compaction_keeps_rows_versions_and_insert_semantics(spark, table, monkeypatch):
    batches = [rows(spark, [(s, d, None) for s in (1, 2, 3)], rank=d + 1) for d in (0, 0, 1)]
    later = [rows(spark, [(s, 0, f"m{k}") for s in (1, 2, 3)]) for k in range(4)]
    for b in batches + later:
        S.insert(spark, table, b)
    before, version = S.read(spark, table), S.head(spark, table)
    n_files = S.files_of(spark, table).count()
    assert S.compact(spark, table, most_files=99) == 0
    assert S.compact(spark, table, most_files=2) > 0
    assert S.files_of(spark, table).count() < n_files and same(S.read(spark, table), before)
    assert same(S.read(spark, table, version=version), before) and S.files_of(spark, table, version=version).count() == n_files
    assert S.insert(spark, table, later[0]) == 0 and S.insert(spark, table, rows(spark, [(9, 0, None)])) == 1
    # a compaction that comes second adds nothing, an insert in between is kept
    for k in range(4):
        S.insert(spark, table, rows(spark, [(s, 0, f"n{k}") for s in (1, 2, 3)]))
    rows_before, real, done = S.read(spark, table).count(), S.commit, []

    def late(*a):
        if not done:
            done.append(1)
            assert S.compact(spark, table, most_files=2) > 0
            assert S.insert(spark, table, rows(spark, [(50, 0, None)])) == 1
        return real(*a)

    monkeypatch.setattr(S, "commit", late)
    assert S.compact(spark, table, most_files=2) == 0
    assert S.read(spark, table).count() == rows_before + 1
    assert S.read(spark, table).select(*KEY).distinct().count() == rows_before + 1


def test_a_replayed_batch_is_told_before_its_rows_are_read(spark, table):
    new = rows(spark, [(1, 0, None), (2, 0, None)])
    assert S.insert(spark, table, new, batch_id="b1") == 2
    broken = new.withColumn("Rank", F.raise_error(F.lit("a row was read")).cast("int"))
    assert S.insert(spark, table, broken, batch_id="b1") == 0


def test_rows_to_insert_sorts_no_row_before_the_shuffle(spark):
    old = rows(spark, [(1, 0, None), (None, None, "m"), (3, 1, "m")])
    new = rows(spark, [(1, 0, None), (1, 0, "m"), (None, None, "m"), (4, None, None), (4, None, None), (3, 1, "m")], rank=5)
    new = new.unionByName(rows(spark, [(1, 0, "m"), (4, None, None)], rank=2))
    for null_safe, want in ((True, [(1, "m", 2), (4, None, 2)]),
                            (False, [(None, "m", 5), (1, None, 5), (1, "m", 2), (4, None, 2), (4, None, 5), (4, None, 5)])):
        for keys in (0, 100):
            add = I.rows_to_insert(old, new, null_safe=null_safe, broadcast_keys=keys)
            got = sorted(((r.SubjectID, r.Model, r.Rank) for r in add.collect()), key=str)
            assert got == sorted(want, key=str)
        lines = add._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
        shuffles = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
        # one shuffle by key, and below it neither a sort nor an aggregate
        assert len(shuffles) == 1
        assert not any("Sort" in x for x in lines[shuffles[0]:])


@pytest.mark.parametrize("null_safe", [True, False])
def test_one_shuffle_and_one_sort_pick_and_place_the_rows(spark, monkeypatch, null_safe):
    monkeypatch.setattr(S, "PIECE_ROWS", 3)
    keys = [(s, d, m) for s in (None, 1, 2, 3) for d in (None, 0, 1) for m in (None, "m")]
    old, new = rows(spark, keys[::3]), rows(spark, keys * 2, 5).unionByName(rows(spark, keys, 2))
    batch, have = (S.placed(x, ("day", 2)) for x in (new, old))
    pairs = batch.groupBy(*S.PLACE).agg(F.count(F.lit(1)).alias("_n"))
    want = I.rows_to_insert(old, new, null_safe)
    for broadcast in (0, 1000):
        monkeypatch.setattr(S, "BROADCAST_KEYS", broadcast)
        got = S.picked(batch, pairs, have, null_safe)
        assert same(got.select(*S.COLUMNS), want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the rows are exchanged by place and piece only, and not again after the window
    assert plan.count("REPARTITION_BY_COL") == 1 and "Exchange" not in plan[:plan.index("Window [")]
    assert plan.count("Sort [") == 1
