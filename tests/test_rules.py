"""Rules of single values, worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.functions import scalars as S
from wardflow.operators import cleaning as C
from wardflow.operators import intervals, ledger, text
from wardflow.sources import tables


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("GBP 40", 4000), ("40gbp", 4000), ("(£12.50)", -1250), ("(-5)", 500), ("1,00", None), ("12.5.0", None), ("1000000.01", None), (None, None), ("£1,234.50", 123450), ("(12.5)", -1250), ("-3", -300), ("1.234", None), ("n/a", None), ("", None)])
def test_money(value, raw, want):
    assert value(C.money_pence(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("2024-02-29", dt.date(2024, 2, 29)), ("3/4/2021", dt.date(2021, 4, 3)), ("03.04.31", dt.date(1931, 4, 3)), ("3 March 2021", dt.date(2021, 3, 3)), ("31/02/2001", None), ("soon", None), ("3 marvellous 2021", None), ("2024-01-15T09:30:00", dt.date(2024, 1, 15)), ("03-Apr-2026", dt.date(2026, 4, 3)), ("3 April 26", dt.date(2026, 4, 3)), ("3/4/30 10:15", dt.date(2030, 4, 3)), ("1 Sept 2024", dt.date(2024, 9, 1)), ("3/apr/2026", None), ("2024-1-5", dt.date(2024, 1, 5)), (None, None)])
def test_dates(value, raw, want):
    assert value(C.read_date(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("9:05", 545), ("14.30", 870), ("2pm", 840), ("12 am", 0), ("25:00", None), ("x", None), ("9", None), ("0930", 570), ("2:15 p.m.", 855), ("03/04/2026 09:30", 570), ("2026-04-03T14:05:00", 845), ("13pm", None), ("09:30:15", 570), (None, None)])
def test_times(value, raw, want):
    assert value(C.read_time(F.lit(raw))) == want


def test_small_readers(value):
    assert value(C.postcode(F.lit("sw1a1aa"))) == "SW1A 1AA"
    assert value(C.phone_digits(F.lit("+44 (0)20 7946 0000"))) == "02079460000"
    assert value(C.email(F.lit(" A@B.Co "))) == "a@b.co"
    assert value(C.search_key(F.lit("  Émile-Zola,  No. 7 "))) == "emile zola no 7"
    assert value(C.csv_cell(F.lit("=1+1"))) == "'=1+1"
    assert tuple(value(C.split_name(F.lit("Weber, Anna Maria")))) == (None, "Anna Maria", "Weber")
    assert C.detect_delimiter('"a,b,c";d;e') == ";"


@pytest.mark.parametrize("raw, parts", [("a" * 160, 1), ("a" * 161, 2), ("€" * 80, 1), ("€" * 81, 2), ("ж" * 70, 1), ("😀" * 36, 2)])
def test_sms(value, raw, parts):
    assert value(S.sms_segments(F.lit(raw))) == parts


def test_uk_clock(value):
    at = lambda s: F.to_timestamp(F.lit(s))
    assert value(S.from_local(at("2024-03-31 01:30:00"))) is None
    assert value(F.date_format(S.from_local(at("2024-10-27 01:30:00")), "HH:mm")) == "00:30"
    assert value(S.local_day(at("2024-06-30 23:30:00"))) == dt.date(2024, 7, 1)


def test_whole_years(value):
    d = lambda s: F.lit(s).cast("date")
    assert value(S.whole_years(d("2004-02-29"), d("2025-02-28"))) == 20
    assert value(S.add_years(d("2004-02-29"), 1)) == dt.date(2005, 2, 28)


@pytest.mark.parametrize("top, want", [(250, 3), (-250, -3), (249, 2), (0, 0)])
def test_rounding(value, top, want):
    assert value(tables.rounded(F.lit(top).cast("long"), 100)) == want


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (2, 5, 6)], "k long, s long, e long")
    blocks = spark.createDataFrame([(1, 15, 35)], "k long, s long, e long")
    assert {tuple(r) for r in intervals.merge_intervals(rows, "k").collect()} == {(1, 0, 20), (1, 30, 40), (2, 5, 6)}
    assert {tuple(r) for r in intervals.subtract(rows, blocks, "k").collect()} == {(1, 20), (2, 1)}


def test_courses_go_to_the_earliest_expiry(spark):
    d = dt.date
    visits = spark.createDataFrame([(1, i, d(2024, 1, i)) for i in range(1, 6)], "patient_id long, visit_id long, day date")
    courses = spark.createDataFrame([(1, 7, d(2024, 1, 1), d(2024, 1, 9), 2), (1, 8, d(2024, 1, 2), d(2024, 1, 4), 5)], "patient_id long, course_id long, starts_on date, expires_on date, sessions int")
    got = {r.visit_id: r.course_id for r in ledger.match_courses(visits, courses).collect()}
    assert got == {1: 7, 2: 8, 3: 8, 4: 8, 5: 7}


def test_near_pairs(spark):
    rows = spark.createDataFrame([(1, list("abcdefghij")), (2, list("abcdefghik")), (3, list("abcdxyzwvu")), (4, ["q"])], "id long, w array<string>")
    assert {(r.a, r.b, r.common) for r in text.near_pairs(rows).collect()} == {(1, 2, 9)}
