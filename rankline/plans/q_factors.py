"""Registered queries: factor reshapes, encodings, scalar functions, base features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankline.functions import columns as C
from rankline.operators import factors as FA
from rankline.operators import features as FE
from rankline.plans.catalog import register, rounded
from rankline.plans.q_history import FIXTURE_VOCAB, pos_sql, positions_sql, rankings
from rankline.plans.sql_twins import with_views
from rankline.schema import DRIVERS
from rankline.sources.fixtures import view

DLIST = ", ".join(DRIVERS)
CHOSEN_SQL = f"list_filter([{DLIST}], lambda x: x IS NOT NULL AND x <> '')"
# Feature columns of a saved one-hot model: every second factor of three drivers, and one that no
# feature set makes any more.
SAVED_COLUMNS = [*(f"Driver{d}_Factor{f}" for d in (3, 9, 17) for f in range(2, 18, 2)), "RetiredFeature"]
SCENARIO_SEED = "rankline"
N_SCENARIOS = 3


def inputs(spark, sf):
    return view(spark, sf, "inputs")


# ---- I1 / H7 / D2 / I2 / D4 ----------------------------------------------------------------

_LONG_SQL = " UNION ALL ".join(
    f"SELECT SubjectID, UpdateDT, Model, 'Driver{i}' AS Driver, Driver{i} AS Factor, {i} AS DriverNumber FROM rankings"
    for i in range(1, 18))


@register("driver_long", with_views("rankings") + _LONG_SQL)
def driver_long(spark, sf):
    return FA.driver_long(rankings(spark, sf), ["SubjectID", "UpdateDT", "Model"])


@register("driver_factor_counts", with_views("rankings") + f"""
SELECT SubjectID, Driver, Factor, count(*) AS Count FROM ({_LONG_SQL}) l
WHERE Factor IS NOT NULL GROUP BY SubjectID, Driver, Factor""")
def driver_factor_counts(spark, sf):
    return FA.driver_factor_counts(rankings(spark, sf), ["SubjectID"])


@register("factor_heatmap", with_views("rankings") + f"""
SELECT SubjectID, Factor, {", ".join(f"count(*) FILTER (WHERE Driver = 'Driver{i}') AS Driver{i}" for i in range(1, 18))}
FROM ({_LONG_SQL}) l WHERE Factor IS NOT NULL GROUP BY SubjectID, Factor""")
def factor_heatmap(spark, sf):
    return FA.factor_heatmap(rankings(spark, sf), ["SubjectID"])


def _vocab_sql() -> str:
    parts = []
    for t in ("rankings", "inputs"):
        parts += [f"SELECT Driver{i} AS Factor FROM {t}" for i in range(1, 18)]
    return f"SELECT DISTINCT Factor FROM ({' UNION ALL '.join(parts)}) f WHERE Factor IS NOT NULL AND Factor <> ''"


@register("factor_vocabulary", with_views("rankings", "inputs") + _vocab_sql())
def factor_vocabulary(spark, sf):
    return FA.vocabulary_frame(rankings(spark, sf), inputs(spark, sf))


# ---- I3 / I6 / I4 / I5 -----------------------------------------------------------------------

@register("factor_positions", with_views("rankings") + f"""
SELECT SubjectID, UpdateDT, Model, {positions_sql(FIXTURE_VOCAB)} FROM rankings""")
def factor_positions(spark, sf):
    return FA.with_positions(rankings(spark, sf).select("SubjectID", "UpdateDT", "Model", *DRIVERS),
                             FIXTURE_VOCAB).drop(*DRIVERS)


@register("factor_positions_last", with_views("inputs") + f"""
SELECT event_id, {positions_sql(FIXTURE_VOCAB, last=True, suffix="_Position")} FROM inputs""")
def factor_positions_last(spark, sf):
    x = inputs(spark, sf).select("event_id", *DRIVERS)
    return FA.with_positions(x, FIXTURE_VOCAB, last=True, suffix="_Position").drop(*DRIVERS)


_ONEHOT_SQL = ", ".join(f"CAST(coalesce(Driver{i} = '{f}', false) AS INTEGER) AS \"Driver{i}_{f}\""
                        for i in range(1, 18) for f in FIXTURE_VOCAB)


@register("factor_onehot", with_views("rankings") + f"""
SELECT SubjectID, UpdateDT, Model, {_ONEHOT_SQL} FROM rankings""")
def factor_onehot(spark, sf):
    return rankings(spark, sf).select("SubjectID", "UpdateDT", "Model", *FA.onehot_columns(FIXTURE_VOCAB))


# ---- J16 / H13 / H4 / H3 / H9 / B11 / B7 / K8 ------------------------------------------------

def _scenario_sql() -> str:
    voc = ", ".join(f"'{f}'" for f in FIXTURE_VOCAB)
    return with_views("rankings") + f"""
, s AS (SELECT DISTINCT SubjectID FROM rankings)
, k AS (SELECT SubjectID, sc AS Scenario, f AS Factor
        FROM s, range(1, {N_SCENARIOS + 1}) t(sc), unnest([{voc}]) u(f))
, o AS (SELECT *, row_number() OVER (PARTITION BY SubjectID, Scenario
          ORDER BY md5(concat_ws('|', '{SCENARIO_SEED}', CAST(SubjectID AS VARCHAR), CAST(Scenario AS VARCHAR), Factor)),
                   Factor) AS pos FROM k)
SELECT SubjectID, CAST(Scenario AS INTEGER) AS Scenario,
       {", ".join(f"max(CASE WHEN pos = {i} THEN Factor END) AS Driver{i}" for i in range(1, 18))}
FROM o GROUP BY SubjectID, Scenario"""


@register("factor_scenarios", _scenario_sql())
def factor_scenarios(spark, sf):
    subj = rankings(spark, sf).select("SubjectID").distinct()
    return FA.factor_scenarios(subj, FIXTURE_VOCAB, N_SCENARIOS, SCENARIO_SEED)


@register("pad_drivers", with_views("inputs") + f"""
SELECT event_id, {", ".join(f"{CHOSEN_SQL}[{i}] AS Driver{i}" for i in range(1, 18))} FROM inputs""")
def pad_drivers(spark, sf):
    x = inputs(spark, sf).select("event_id", C.pad_to(C.nonblank(C.driver_array())).alias("_d"))
    return x.select("event_id", *[F.col("_d")[i - 1].alias(f"Driver{i}") for i in range(1, 18)])


@register("calendar_features", with_views("rankings") + """
SELECT SubjectID, UpdateDT, CAST(year(UpdateDT) AS INTEGER) AS Year, CAST(month(UpdateDT) AS INTEGER) AS Month,
       CAST(day(UpdateDT) AS INTEGER) AS DayOfMonth, CAST(isodow(UpdateDT) - 1 AS INTEGER) AS DayOfWeek FROM rankings""")
def calendar_features(spark, sf):
    return FE.calendar_columns(rankings(spark, sf).select("SubjectID", "UpdateDT"))


@register("compose_timestamp", with_views("inputs") + """
SELECT event_id, strftime(UpdateDT, '%Y-%m-%d') AS date_text, strftime(UpdateDT, '%H:%M') AS time_text,
       strptime(strftime(UpdateDT, '%Y-%m-%d') || ' ' || strftime(UpdateDT, '%H:%M') || ':00', '%Y-%m-%d %H:%M:%S')
         AS UpdateDT
FROM inputs""")
def compose_timestamp(spark, sf):
    x = inputs(spark, sf).select("event_id", F.date_format("UpdateDT", "yyyy-MM-dd").alias("date_text"),
                                 F.date_format("UpdateDT", "HH:mm").alias("time_text"))
    return x.withColumn("UpdateDT", C.compose_ts("date_text", "time_text"))


@register("rounded_rank", """
SELECT event_id, round(value / 2, 6) AS predicted, CAST(round_even(value / 2, 0) AS INTEGER) AS rounded_rank
FROM events""")
def rounded_rank(spark, sf):
    from rankline.sources.tables import events
    x = events(spark, sf).select("event_id", (F.col("value") / 2).alias("predicted"))
    return rounded(x.withColumn("rounded_rank", C.half_even_int("predicted")))


@register("valid_inputs", with_views("inputs") + f"""
SELECT event_id, SubjectID, CAST(len({CHOSEN_SQL}) AS INTEGER) AS factors_used FROM inputs WHERE len({CHOSEN_SQL}) > 0""")
def valid_inputs(spark, sf):
    x = inputs(spark, sf).select("event_id", "SubjectID", C.count_chosen(C.driver_array()).alias("factors_used"))
    return x.where(F.col("factors_used") > 0)


@register("input_defaults", with_views("inputs") + f"""
SELECT event_id, coalesce(nullif(SubjectID, ''), 'new_input') AS SubjectID,
       {", ".join(f"nullif({d}, '') AS {d}" for d in DRIVERS)} FROM inputs""")
def input_defaults(spark, sf):
    return FE.input_defaults(inputs(spark, sf)).select("event_id", "SubjectID", *DRIVERS)


@register("input_defaults_new_subject", with_views("inputs") + """
SELECT event_id, coalesce(CASE WHEN event_id % 19 = 0 THEN 'new-' || event_id END, nullif(SubjectID, ''), 'new_input') AS SubjectID
FROM inputs""")
def input_defaults_new_subject(spark, sf):
    """An id given for a new subject overrides the selected one; a blank one does not."""
    new = F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("new-"), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    return FE.input_defaults(inputs(spark, sf).withColumn("NewSubjectID", new)).select("event_id", "SubjectID")


@register("driver_long_discovered", with_views("rankings") + " UNION ALL ".join(
    f"SELECT SubjectID, UpdateDT, Model, 'Driver{i}' AS Driver, Driver{i} AS Factor, true AS named FROM rankings UNION ALL "
    f"SELECT SubjectID, UpdateDT, Model, 'c{i}', Driver{i}, false FROM rankings" for i in range(1, 18)))
def driver_long_discovered(spark, sf):
    """Long form over discovered driver columns: by their names, and by their places where no column has such a name."""
    r = rankings(spark, sf)
    bare = r.withColumnsRenamed({d: f"c{i + 1}" for i, d in enumerate(DRIVERS)})
    ids = ["SubjectID", "UpdateDT", "Model"]
    parts = [FA.driver_long(df, ids, FA.driver_columns(df)).drop("DriverNumber").withColumn("named", F.lit(df is r)) for df in (r, bare)]
    return parts[0].unionByName(parts[1])


@register("to_datetime", with_views("rankings_dirty") + """
SELECT UpdateDT AS text, TRY_CAST(UpdateDT AS TIMESTAMP) AS parsed, count(*) AS n FROM rankings_dirty GROUP BY ALL""")
def to_datetime(spark, sf):
    """Generic reading of time texts: what is no time becomes NULL."""
    x = view(spark, sf, "rankings_dirty").select(F.col("UpdateDT").alias("text"), C.to_datetime("UpdateDT").alias("parsed"))
    return x.groupBy("text", "parsed").agg(F.count(F.lit(1)).alias("n"))


@register("dq_unique_factors", with_views("inputs") + f"""
SELECT event_id, SubjectID, CAST(len({CHOSEN_SQL}) AS INTEGER) AS n_chosen,
       CAST(len(list_distinct({CHOSEN_SQL})) AS INTEGER) AS n_distinct
FROM inputs WHERE len({CHOSEN_SQL}) > len(list_distinct({CHOSEN_SQL}))""")
def dq_unique_factors(spark, sf):
    arr = C.nonblank(C.driver_array())
    x = inputs(spark, sf).select("event_id", "SubjectID", F.size(arr).alias("n_chosen"),
                                 F.size(F.array_distinct(arr)).alias("n_distinct"))
    return x.where(F.col("n_chosen") > F.col("n_distinct"))


# ---- J2 / I5 / J3 / D3 -----------------------------------------------------------------------

_BASE_COMMON = """event_id, coalesce(nullif(i.SubjectID, ''), 'new_input') AS SubjectID, i.Rank, i.UpdateDT,
       CAST(year(i.UpdateDT) AS INTEGER) AS Year, CAST(month(i.UpdateDT) AS INTEGER) AS Month,
       CAST(day(i.UpdateDT) AS INTEGER) AS DayOfMonth, CAST(isodow(i.UpdateDT) - 1 AS INTEGER) AS DayOfWeek,
       CAST(coalesce(datesub('day', s.t0, i.UpdateDT), 0) AS BIGINT) AS DaysSinceFirst,
       CAST(0 AS BIGINT) AS DaysSincePrev, round(coalesce(s.mean_rank, 50.0), 6) AS PrevRank,
       0 AS RankChange"""
# Observed rows are the reference; stored predictions are not.
_REF = ", s AS (SELECT min(UpdateDT) AS t0, avg(Rank) AS mean_rank FROM rankings WHERE Model IS NULL)"
_NB = {d: f"nullif(i.{d}, '')" for d in DRIVERS}


def _pos_last_sql(suffix="_Position") -> str:
    return ", ".join(pos_sql(f, True, f + suffix, drivers=[f"i.{d}" for d in DRIVERS]) for f in FIXTURE_VOCAB)


def _onehot_sql(prefix="i.") -> str:
    return ", ".join(f"CAST(coalesce({prefix}Driver{i} = '{f}', false) AS INTEGER) AS \"Driver{i}_{f}\""
                     for i in range(1, 18) for f in FIXTURE_VOCAB)


def _base(spark, sf):
    return FE.base_features(inputs(spark, sf), FE.training_rows(rankings(spark, sf)), FIXTURE_VOCAB, id_cols=["event_id"])


@register("base_features_positional", with_views("rankings", "inputs", extra=[_REF[2:]]) + f"""
SELECT {_BASE_COMMON}, {_pos_last_sql()} FROM inputs i CROSS JOIN s""")
def base_features_positional(spark, sf):
    return rounded(_base(spark, sf)[0])


@register("base_features_onehot", with_views("rankings", "inputs", extra=[_REF[2:]]) + f"""
SELECT {_BASE_COMMON}, {_onehot_sql()} FROM inputs i CROSS JOIN s""")
def base_features_onehot(spark, sf):
    return rounded(_base(spark, sf)[1])


@register("align_features", with_views("inputs") + f"""
SELECT event_id, {", ".join(
    f"CAST(coalesce({c.split('_')[0]} = '{c.split('_')[1]}', false) AS INTEGER) AS \"{c}\"" if c.startswith("Driver")
    else f"0 AS \"{c}\"" for c in SAVED_COLUMNS)} FROM inputs""")
def align_features(spark, sf):
    onehot = _base(spark, sf)[1]
    return FE.align_features(onehot, ["event_id", *SAVED_COLUMNS])


SCALED = ["Year", "Month", "DayOfMonth", "DayOfWeek", "DaysSinceFirst", "DaysSincePrev", "PrevRank", "RankChange"]


def _scaled_sql() -> str:
    base = f"SELECT {_BASE_COMMON}, {_pos_last_sql()} FROM inputs i CROSS JOIN s"
    fitted = f"SELECT {_BASE_COMMON[_BASE_COMMON.index('CAST(year'):]} FROM rankings i CROSS JOIN s WHERE i.Model IS NULL"
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in SCALED)
    scaled = ", ".join(f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE CAST({c} AS DOUBLE) END, 6) AS {c}"
                       for c in SCALED)
    pos = ", ".join(f'"{f}_Position"' for f in FIXTURE_VOCAB)
    return with_views("rankings", "inputs", extra=[_REF[2:], f"b AS ({base})", f"rb AS ({fitted})", f"st AS (SELECT {stats} FROM rb)"]) + f"""
SELECT event_id, SubjectID, Rank, UpdateDT, {scaled}, {pos} FROM b CROSS JOIN st"""


@register("scaled_features", _scaled_sql())
def scaled_features(spark, sf):
    """Inputs scaled by the observed rows, so a row scales alike in every batch."""
    reference = FE.training_rows(rankings(spark, sf))
    fitted = FE.base_features(reference, reference, FIXTURE_VOCAB)[0]
    return rounded(FE.scale_columns(_base(spark, sf)[0], SCALED, fit_on=fitted))


@register("reference_stats", with_views("rankings") + """
SELECT count(*) AS n_rows, min(UpdateDT) AS first_update, max(UpdateDT) AS last_update,
       round(avg(Rank), 6) AS mean_rank, round(stddev_samp(Rank), 6) AS std_rank,
       min(Rank) AS min_rank, max(Rank) AS max_rank FROM rankings""")
def reference_stats(spark, sf):
    r = rankings(spark, sf)
    return rounded(r.agg(F.count(F.lit(1)).alias("n_rows"), F.min("UpdateDT").alias("first_update"),
                         F.max("UpdateDT").alias("last_update"), F.avg("Rank").alias("mean_rank"),
                         F.stddev_samp("Rank").alias("std_rank"), F.min("Rank").alias("min_rank"),
                         F.max("Rank").alias("max_rank")))
