"""Nothing goes missing without a word: sweeps that stop, loads that stop, queues over days, and files beyond a limit."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardflow.sources import episodes
from wardflow.streaming import steps, sweeps


@pytest.fixture
def timed(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k)) for k in range(200)]
    return spark.createDataFrame(rows, "id long, at timestamp")


@pytest.mark.parametrize("dies", ["reading", "writing", "marking"])
def test_a_sweep_that_stops_loses_and_doubles_nothing(spark, timed, tmp_path, monkeypatch, dies):
    store = steps.SweepStore(spark, f"file://{tmp_path}/sweeps")
    take = lambda rows: rows.select("id", "at")
    store.run(timed, "at", "2024-01-01 06:00:00", take, ("id", "at"))
    first = store.results(timed.schema).count()

    def stops(rows):
        if dies == "reading":
            raise RuntimeError("consumer died")
        if dies == "writing":
            return take(rows).withColumn("id", F.when(F.col("id") % 7 == 0, F.raise_error("died").cast("long")).otherwise(F.col("id")))
        return take(rows)

    if dies == "marking":  # the rows are written, the mark isn't
        real = store.spark.range
        monkeypatch.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver died")))
    with pytest.raises(Exception):
        store.run(timed, "at", "2024-01-01 12:00:00", stops, ("id", "at"))
    monkeypatch.undo()
    assert store.results(timed.schema).count() == first
    again = steps.SweepStore(spark, f"file://{tmp_path}/sweeps")  # a new driver
    for now in ("2024-01-01 12:00:00", "2024-01-01 12:30:00", "2024-01-03 00:00:00"):
        again.run(timed, "at", now, take, ("id", "at"))
    got = [r.id for r in again.results(timed.schema).collect()]
    assert sorted(got) == list(range(200))


def test_sweeps_of_bounded_size_come_to_the_end(spark, timed, tmp_path):
    store = steps.SweepStore(spark, f"file://{tmp_path}/sweeps", "1 hour")
    for _ in range(5):
        store.run(timed, "at", "2024-01-03 00:00:00", lambda rows: rows.select("id", "at"), ("id", "at"), most=60)
    got = store.results(timed.schema)
    assert sorted(r.id for r in got.collect()) == list(range(200))
    assert max(r["count"] for r in got.groupBy("sweep").count().collect()) <= 60


def test_rows_written_late_come_with_the_overlap(spark, timed, tmp_path):
    store = steps.SweepStore(spark, f"file://{tmp_path}/sweeps")
    take = lambda rows: rows.select("id", "at")
    store.run(timed.where("id % 5 != 0"), "at", "2024-01-01 06:00:00", take, ("id", "at"))
    store.run(timed, "at", "2024-01-02 00:00:00", take, ("id", "at"))
    got = sorted(r.id for r in store.results(timed.schema).collect())
    assert len(got) == len(set(got))
    late = [k for k in range(0, 52, 5) if 7 * k > 4 * 60]  # those within two hours of the first mark
    assert set(late) <= set(got)


def test_a_load_without_its_audit_row_is_not_there(spark, tmp_path, monkeypatch):
    rows = spark.range(100).withColumnRenamed("id", "k")
    at, audit = f"file://{tmp_path}/rows", f"file://{tmp_path}/audit"
    steps.bulk_load(rows.where("k < 50"), at, audit, "load/1", "k")
    with pytest.raises(Exception):
        steps.bulk_load(rows.where(F.when(F.col("k") == 99, F.raise_error("died").isNull()).otherwise(F.lit(True))), at, audit, "load 2", "k")
    assert steps.loaded(spark, at, audit, rows.schema, "long").count() == 50
    steps.bulk_load(rows.where("k >= 50"), at, audit, "load 2", "k")
    steps.bulk_load(rows.where("k < 50"), at, audit, "load/1", "k")
    assert steps.loaded(spark, at, audit, rows.schema, "long").count() == 100
    assert sorted(tuple(r) for r in steps.audits(spark, audit, "long").collect()) == [("load 2", 50, 50, 99), ("load/1", 50, 0, 49)]


def test_a_queue_takes_an_id_once_whatever_its_day(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = "item long, day date"
    for k, rows in enumerate([[(1, dt.date(2024, 1, 1)), (2, None)], [(1, dt.date(2024, 1, 2)), (2, None), (3, dt.date(2024, 1, 2))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sweeps.queue_stream(stream, "item", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint-{k}")
    assert sorted(r.item for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2, 3]


def test_episode_files_beyond_a_limit_have_issues(spark):
    note = {"date": "2026-04-03", "subjective": "x" * 300}
    files = [("ok", json.dumps({"notes": [note]})), ("long", json.dumps({"notes": [note] * 20})), ("many", json.dumps({"notes": [{"date": "2026-04-03"}] * 9})), ("bad", "{"), ("none", None)]
    read = episodes.read_json(spark.createDataFrame(files, "k string, content string"), "k", most_notes=8, most_chars=2000)
    assert {(r.k, r.code) for r in read["issues"].collect()} == {("long", "TOO_LONG"), ("many", "TOO_MANY_NOTES"), ("bad", "NOT_READABLE"), ("none", "NOT_READABLE")}
    assert {r.k for r in read["notes"].collect()} == {"ok"}


def test_csv_cells_with_breaks_long_rows_and_headers_twice(spark):
    text = '# Patient: Ann, "A"\nDate,Type,date,Note\n2026-04-03,a,late,"one\n\ntwo, ""three"""\r\n1,2,3,4,5\n2026-04-04,b\n'
    read = episodes.read_csv_notes(spark.createDataFrame([(1, text), (2, "x" * 500), (3, None), (4, "")], "k long, content string"), "k", 400)
    rows = {r.n: r.row for r in read["rows"].collect()}
    assert rows == {0: {"date": "2026-04-03", "type": "a", "note": 'one\n\ntwo, "three"'}, 2: {"date": "2026-04-04", "type": "b", "note": ""}}
    assert sorted((r.k, r.code, r.at) for r in read["issues"].collect()) == [(1, "HEADER_TWICE", 2), (1, "ROW_TOO_LONG", 1), (2, "TOO_LONG", -1)]
    assert [tuple(r) for r in read["facts"].collect()] == [(1, "patient", 'Ann, "A"')]


def test_receipts_of_a_busy_person(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    sent = [(k, 1, at(k * 13)) for k in range(40)]
    got = [(1000 + k, 1, at(k * 5 + 0.5)) for k in range(110)] + [(2000, 2, at(1)), (2001, 1, at(30))]
    schema = "event_id long, user_id long, at timestamp"
    found = steps.receipts(spark.createDataFrame(sent, schema), spark.createDataFrame(got, schema)).collect()
    want = {(m, r) for m, u, a in sent for r, v, b in got if u == v and a <= b <= a + dt.timedelta(minutes=30)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
