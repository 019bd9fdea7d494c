"""Calendar rules, readers of typed text and polled jobs, worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.functions import calendar as K
from wardflow.functions import scalars as S
from wardflow.operators import classify as C
from wardflow.streaming import sweeps as W


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


def at(text):
    return F.lit(text).cast("timestamp")


def text_of(instant):
    return F.date_format(instant, "yyyy-MM-dd HH:mm")


@pytest.mark.parametrize("wall, want", [("2024-03-31 00:30", "2024-03-31 00:30"), ("2024-03-31 01:30", None), ("2024-10-27 01:30", "2024-10-27 00:30"), ("2024-07-01 00:30", "2024-06-30 23:30")])
def test_clock_changes(value, wall, want):
    assert value(text_of(S.from_local(at(wall)))) == want


def test_days_of_23_and_25_hours(spark):
    hour, start = 3_600_000_000, lambda s: int(dt.datetime.fromisoformat(s + "+00:00").timestamp() * 1e6)
    rows = spark.createDataFrame([(1, start("2024-03-30T00:00"), start("2024-04-01T00:00")), (2, start("2024-10-26T23:00"), start("2024-10-28T00:00")), (3, 5, 5)], "id long, s long, e long")
    got = {(r.id, str(r.day)): (r.e - r.s) // hour for r in K.local_day_pieces(rows).collect()}
    assert got == {(1, "2024-03-30"): 24, (1, "2024-03-31"): 23, (1, "2024-04-01"): 1, (2, "2024-10-27"): 25}


@pytest.mark.parametrize(
    "due, starts, want",
    [
        ("2024-01-10 12:00", "2024-01-11 12:00", "2024-01-10 12:00"),
        ("2024-01-10 22:00", "2024-01-11 12:00", "2024-01-11 08:00"),
        ("2024-01-10 07:00", "2024-01-10 08:30", "2024-01-09 20:45"),
        ("2024-07-10 20:30", "2024-07-11 12:00", "2024-07-11 07:00"),
    ],
)
def test_quiet_hours(value, due, starts, want):
    assert value(text_of(K.out_of_quiet(at(due), at(starts), 21 * 60, 8 * 60))) == want


def test_reminder_at_a_summer_clock_time(value):
    due = K.reminder_due(at("2024-07-10 09:00"), F.lit(None).cast("int"), F.lit(2), F.lit(570))
    assert value(text_of(due)) == "2024-07-08 08:30"
    assert value(text_of(K.reminder_due(at("2024-07-10 09:00"), F.lit(3), F.lit(2), F.lit(570)))) == "2024-07-10 06:00"


def test_custom_periods(value):
    day = lambda s: F.lit(s).cast("date")
    assert value(K.custom_period(day("2024-01-01"), day("2024-01-31"))).days == 31
    assert value(K.custom_period(day("2024-02-01"), day("2024-01-31"))) is None
    assert value(K.custom_period(day("2024-01-01"), day("2025-01-03"))) is None


def test_rules_that_never_meet(value):
    day = lambda s: F.lit(s).cast("date")
    meet = lambda ea, eb, to=None: value(K.ever_together(F.lit(1), F.lit(ea), day("2024-01-01"), F.lit(eb), day("2024-01-08"), F.lit(to).cast("date")))
    assert not meet(2, 2)
    assert meet(2, 3)
    assert not meet(2, 3, "2024-01-20")


@pytest.mark.parametrize("raw, want", [("Yes please!", "confirm"), ("no", "cancel"), ("opt out", "stop"), ("OPT", "unknown"), ("...", "unknown"), ("", "unknown"), (None, "unknown")])
def test_replies(value, raw, want):
    assert value(C.reply_intent(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("m545", "M54.5"), (" S93.4 ", "S93.4"), ("M54", "M54"), ("M5", None), ("M54.555", None), (None, None)])
def test_diagnosis_codes(value, raw, want):
    assert value(C.diagnosis_code(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("sw1a 1aa", "SW1A"), ("mk9", "MK9"), ("M1 1AE", "M1"), ("12345", None), ("", None)])
def test_districts(value, raw, want):
    assert value(C.outward_code(F.lit(raw))) == want


def test_ids_with_a_time(value):
    now = 1_700_000_000_123
    assert value(C.time_of_id(C.time_id_bound(F.lit(now)))) == now
    assert value(C.time_of_id(F.lit("short"))) is None
    assert value(C.time_id_bound(F.lit(now)) < C.time_id_bound(F.lit(now + 1)))


def test_headers():
    fields = {"first": ["first name", "forename"], "last": ["last name", "surname"], "code": ["postcode"], "born": ["date of birth", "dob"]}
    got = C.suggest_mapping(fields, ["Patient Surname", "Fname", "pcode", "Forename", "Notes"])
    assert got == {"first": 1, "last": 0, "code": 2, "born": None}


@pytest.mark.parametrize("raw, want", [("If yes, give details", ("yes", "any")), ("If no to both", ("no", "all")), ("If other, say which", ("other", "any")), ("If given", ("filled", "any")), ("Details", None)])
def test_printed_conditions(value, raw, want):
    got = value(C.condition_of(F.lit(raw)))
    assert (got and tuple(got)) == want


def test_boxes_that_name_nothing(value):
    assert [value(C.names_something(F.lit(t))) for t in ("None reported.", "N/A", "no restrictions", "Walking", "  ")] == [False, False, False, True, None]


def test_open_conditions(spark):
    rows = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False), (3, False), (4, True), (4, True)], "k int, a boolean")
    got = {r.k: (r.any, r.all) for r in rows.groupBy("k").agg(C.applies(F.col("a"), True, "any").alias("any"), C.applies(F.col("a"), True, "all").alias("all")).collect()}
    assert got == {1: (True, None), 2: (None, False), 3: (False, False), 4: (True, True)}


def test_search_predicates(spark):
    rows = spark.createDataFrame([(712, dt.date(1980, 4, 3), "02079460000", "a@b.co", "Ann Weber"), (5, None, "0712000000", None, "Bo")], "n long, b date, p string, e string, name string")
    found = lambda t: [r.n for r in rows.where(C.search_predicate(t, "n", "b", "p", "e", "name")).collect()]
    assert [found(t) for t in ("712", "3/4/1980", "+44 2079460000", "071200", "A@B.co", "weber ann", "bo x")] == [[712], [712], [712], [5], [712], [712], []]


def test_sweep_looks_back_and_stops_at_now(spark):
    rows = spark.createDataFrame([(t,) for t in (1, 5, 9, 10, 11)], "t long")
    assert {r.t for r in W.sweep(rows, F.col("t"), F.lit(8), F.lit(10), 3).collect()} == {9, 10}


def test_stream_queue_takes_each_once(spark, sf):
    got = [r.event_id for r in W.stream_queued_once(spark, sf).collect()]
    want = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'view'").count()
    assert len(got) == len(set(got)) == want


def test_updates_need_the_revision(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 1, "c")], "k int, rev long, v string")
    changes = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, rev long, v string")
    assert {(r.k, r.rev, r.v) for r in W.update_if(rows, changes, "k", "rev", "v").collect()} == {(1, 2, "x"), (2, 2, "b"), (3, 1, "c")}


def test_unlisted_models_cost_most(value):
    prices = {"small": 0.5, "large": 4.0}
    assert [value(W.token_cost(F.lit(m), F.lit(3), prices)) for m in (" Small ", "large", "new", None)] == [2, 12, 12, 12]
