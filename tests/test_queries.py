"""Every query of the library against its SQL, and rows of those that SQL can't say."""

import datetime as dt
import math

import duckdb
import pytest

from wardflow import registry
from wardflow.sources.tables import appointments

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_as_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert got == want


def test_streams_end_with_the_batch_rows(spark, sf):
    q = registry.queries()
    batch = {(r.window_s, r.user_id): r.hits for r in q["rate_limit_windows"](spark, sf).collect()}
    stream = {(r.window_s, r.user_id): r.hits for r in q["stream_rate_limit_windows"](spark, sf).collect()}
    assert stream and stream.items() <= batch.items()
    last = max(s for s, _ in batch)
    assert all(s > last - 4 * 3600 for s, _ in batch.keys() - stream.keys())  # what the watermark still holds open
    assert q["stream_event_dedupe"](spark, sf).count() == q["event_dedupe"](spark, sf).first().distinct_events


def test_no_row_is_vacuous(sf):
    """Every query with SQL has rows over the tables that it is compared on."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet'")
    assert [n for n, sql in registry.oracle_sql().items() if con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0] == []


def test_greedy_courses_against_plain_version(spark, sf):
    """Visits in order of day and id, each with the earliest-expiring course of its patient that is open and not used up."""
    a = appointments(spark, sf).collect()
    courses, want = {}, {}
    for r in a:
        if r.status == "booked":
            courses.setdefault(r.patient_id, []).append([r.day + dt.timedelta(9), r.appointment_id, r.day, 3])
    for r in sorted((r for r in a if r.outcome == "attended"), key=lambda r: (r.day, r.appointment_id)):
        open_ = [c for c in courses.get(r.patient_id, ()) if c[2] <= r.day <= c[0] and c[3]]
        best = min(open_, default=None)
        want[r.appointment_id] = best and best[1]
        if best:
            best[3] -= 1
    got = {r.visit_id: r.course_id for r in registry.queries()["greedy_courses"](spark, sf).collect()}
    assert got == want and any(got.values()) and not all(got.values())


def test_sentences_stand_where_they_say(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.queries()["sentences"](spark, sf).collect()
    assert got
    for r in got:
        assert texts[r.doc_id][r.start : r.start + len(r.text)] == r.text
