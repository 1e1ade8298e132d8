"""Serving features from per-slice summaries: equal to the windows over all rows, whatever is up to date."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankline.operators import features as FE
from rankline.operators import summaries as SU
from rankline.schema import DRIVERS, RANKINGS
from rankline.sources import store as S

T0 = dt.datetime(2022, 3, 1)
INPUT = "event_id long, SubjectID long, " + ", ".join(f"{d} string" for d in DRIVERS) + ", UpdateDT timestamp_ntz"


def observed(spark, rows):
    return spark.createDataFrame([(s, r, *(["A"] + [None] * 16), t, m is None, m) for s, r, t, m in rows], RANKINGS)


def random_rows(n, seed, days=9):
    rnd = random.Random(seed)
    out = {}
    while len(out) < n:
        t = None if rnd.random() < 0.02 else T0 + dt.timedelta(days=rnd.randint(0, days - 1), hours=rnd.choice((0, 5, 23)), seconds=rnd.randint(0, 2))
        m = rnd.choice((None, None, None, "m"))
        s = rnd.choice((1, 1, 1, 2, 3, 4, 5, None))
        out[s, t, m] = (s, rnd.choice((None, *range(1, 266))), t, m)
    return list(out.values())


def inputs(spark, seed, n=60):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice((1, 2, 3, 4, 77, None)), *(["A"] + [""] * 16),
             None if rnd.random() < 0.05 else T0 + dt.timedelta(days=rnd.randint(-1, 11), hours=rnd.choice((0, 5, 23)), seconds=rnd.randint(0, 2)))
            for i in range(n)]
    return spark.createDataFrame(rows, INPUT)


def same(spark, table, new):
    a = SU.serving_features(spark, table, new, ["A"])
    b = FE.serving_features(S.read(spark, table), new, ["A"])
    doubles = ["AvgPreviousRanks", "AvgPreviousRankChanges"]
    a, b = (x.withColumns({c: F.round(c, 9) for c in doubles}).select(*b.columns) for x in (a, b))
    return a.count() == new.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("period", ["day", "month"])
def test_equal_to_the_windows_before_between_and_after_refreshes(spark, tmp_path, period):
    table = f"{tmp_path}/t"
    S.create_if_absent(spark, table, period=period, buckets=2)
    new = inputs(spark, 5)
    assert same(spark, table, new) and SU.refresh(spark, table) == 0     # an empty table
    S.insert(spark, table, observed(spark, random_rows(120, 1)))
    assert same(spark, table, new)                                       # nothing summarised
    assert SU.refresh(spark, table) > 0 and SU.refresh(spark, table) == 0
    assert same(spark, table, new)                                       # all summarised
    S.insert(spark, table, observed(spark, random_rows(15, 2, days=3)))  # late rows
    assert same(spark, table, new)                                       # part of it out of date
    assert 0 < SU.refresh(spark, table) and same(spark, table, new)
    # compacted rows are no newer: the summaries stay up to date
    assert S.compact(spark, table, most_files=1) > 0
    assert SU.refresh(spark, table) == 0 and same(spark, table, new)


def test_late_rows_make_only_their_slice_out_of_date_and_predictions_none(spark, tmp_path):
    table = f"{tmp_path}/t"
    S.create_if_absent(spark, table, buckets=1)
    S.insert(spark, table, observed(spark, [(1, 10 + d, T0 + dt.timedelta(days=d), None) for d in range(8)]))
    assert SU.refresh(spark, table) == 8
    S.insert(spark, table, observed(spark, [(1, 99, T0 + dt.timedelta(days=2, hours=1), None)]))
    S.insert(spark, table, observed(spark, [(1, 7, T0 + dt.timedelta(days=5, hours=1), "m")]))
    assert SU.refresh(spark, table) == 1
    new = spark.createDataFrame([(1, 1, *(["A"] + [""] * 16), T0 + dt.timedelta(days=20))], INPUT)
    r = SU.serving_features(spark, table, new, ["A"]).first()
    ranks = [10, 11, 12, 99, 13, 14, 15, 16, 17]
    steps = [b - a for a, b in zip(ranks, ranks[1:])]
    assert (r.PrevRank, r.DaysSincePrev, r.DaysSinceFirst) == (17, 13, 20)
    assert r.AvgPreviousRanks == pytest.approx(sum(ranks) / 9) and r.AvgPreviousRankChanges == pytest.approx(sum(steps) / 8)


def test_rows_read_are_bounded_by_the_summaries(spark, tmp_path):
    table = f"{tmp_path}/t"
    S.create_if_absent(spark, table, buckets=1)
    # 40 rows of each of two subjects on each of six days
    S.insert(spark, table, observed(spark, [(s, 1 + k, T0 + dt.timedelta(days=d, minutes=k), None)
                                            for s in (1, 2) for d in range(6) for k in range(40)]))
    SU.refresh(spark, table)
    batch = S.placed(spark.createDataFrame([(1, T0 + dt.timedelta(days=4, minutes=5))], "SubjectID long, UpdateDT timestamp_ntz"),
                     S.layout(spark, table))
    rows, kept = SU.history_items(spark, table, batch)
    assert rows.count() == 80 and {r.UpdateDT.day for r in rows.collect()} == {5}   # its own slice only
    assert kept.groupBy("SubjectID").count().collect()[0]["count"] == 4              # one row for each earlier slice
    later = S.placed(spark.createDataFrame([(1, T0 + dt.timedelta(days=30))], "SubjectID long, UpdateDT timestamp_ntz"),
                     S.layout(spark, table))
    rows, kept = SU.history_items(spark, table, later)
    assert rows.count() == 0 and kept.count() == 12


def test_two_refreshes_at_once_do_not_count_twice(spark, tmp_path, monkeypatch):
    table = f"{tmp_path}/t"
    S.create_if_absent(spark, table, buckets=1)
    S.insert(spark, table, observed(spark, random_rows(40, 3)))
    real, done = S.commit, []

    def late(*a):
        if not done:
            done.append(1)
            assert SU.refresh(spark, table) > 0
        return real(*a)

    monkeypatch.setattr(S, "commit", late)
    SU.refresh(spark, table)
    monkeypatch.setattr(S, "commit", real)
    assert same(spark, table, inputs(spark, 8))
