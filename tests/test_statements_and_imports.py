"""Statements, durations, imports, exports, pages and registries, worked by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wardflow.operators import cleaning as C
from wardflow.operators import figures, imports, paging, repeats, statements
from wardflow.plans import opening, records
from wardflow.sources import episodes
from wardflow.streaming import jobs


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ("seen 12/03/26 and 12 March 2026", [("date", "2026-03-12"), ("date", "2026-03-12")]),
        ("March 12th, 2026; in March 2027; on the 15th of April", [("date", "2026-03-12"), ("month_year", "2027-03"), ("day_month", "04-15")]),
        ("6–7 wks, two to three months, 3/12 and 5/7", [("duration", "6:week"), ("duration", "7:week"), ("duration", "2:month"), ("duration", "3:month"), ("duration", "3:month"), ("duration", "5:day")]),
        ("at 14:30, ref N-003", []),
        ("L4/5 and C3 in 2015", [("level", "L4"), ("level", "L5"), ("level", "C3"), ("year", "2015")]),
        ("7/10, 1,000 steps, 0.50 km, twenty-five, twice", [("number", "7"), ("number", "10"), ("number", "1000"), ("number", "0.5"), ("number", "25"), ("number", "2")]),
        ("", []),
    ],
)
def test_figures(text, want):
    found = figures.figures_of(text)
    assert [f[:2] for f in found] == want
    assert all(text[at : at + len(raw)] == raw for _, _, raw, at in found)


def test_figures_stand_where_they_say(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        assert all(text[at : at + len(raw)] == raw for _, _, raw, at in figures.figures_of(text))


M = 30.4375


@pytest.mark.parametrize("text, want", [("0-3 MONTHS", (0, 3 * M)), ("Over 12 months", (12 * M, None)), ("12 months +", (12 * M, None)), ("up to 6 weeks", (0, 42)), ("two to four weeks", (14, 28)), ("6 wks", None), ("3-1 days", None), ("a year or more.", (365.25, None)), ("over 2 years or more", None), ("", None)])
def test_bands(value, text, want):
    got = value(statements.band(F.lit(text)))
    assert (got and (got.low, got.high)) == want


def test_repeats_need_figures_negation_and_contrast_to_agree(spark):
    texts = ["Lumbar flexion is limited by 50 percent today", "Today lumbar flexion is clearly limited by 50 percent", "Lumbar flexion is limited by 10 percent today", "Lumbar flexion is never limited by 50 percent today", "The left knee hurts when walking uphill slowly", "The right knee hurts when walking uphill slowly", "Short one"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, place long, sentence string")
    assert {(r.place, r.twin) for r in repeats.repeated_sentences_of(rows, "doc", "place").collect()} == {(1, 0)}


def test_multisets(value):
    a = lambda *x: F.array(*map(F.lit, x))
    assert value(repeats.multiset_within(a(1, 1, 2), a(2, 1, 3, 1))) and not value(repeats.multiset_within(a(1, 1), a(1, 2)))


def test_validators_can_be_turned_off(spark):
    rows = spark.createDataFrame([(1, "Dear «Name», TBC"), (2, " ")], "doc_id long, text string")
    names = lambda df: [r.check_name for r in df.orderBy("place").collect()]
    assert names(statements.run_validators(rows)) == ["placeholders", "merge-fields", "gaps"]
    assert names(statements.run_validators(rows, off=("gaps",))) == ["placeholders", "merge-fields"]


def test_patient_row(spark):
    cells = {"ref": "P1", "firstName": "Dr Megan", "lastName": "Hart", "dateOfBirth": "1/2/2030", "sex": "woman", "marketingSms": "yes", "phoneMobile": "+44 7700 900123", "status": "left"}
    r = imports.read_rows(spark.createDataFrame([Row(**cells)]), "patients", F.lit("2026-06-01").cast("date")).first()
    assert (r.usable, r.v_title, r.v_firstName, r.v_dateOfBirth, r.v_sex, r.v_status, r.v_phoneMobile) == (True, "Dr", "Megan", None, "female", "archived", "+44 7700 900123")
    assert r.issues == ["DATE_OF_BIRTH_RANGE:warning:dateOfBirth", "MARKETING_IMPORTED:warning:marketingSms"]


def test_titles_and_keys(value):
    assert tuple(value(C.split_name(F.lit("Professor Ann  Li")))) == ("Prof", "Ann", "Li")
    assert value(C.split_name(F.lit("Cher"))) is None
    assert value(C.search_key(F.lit("Łódź Ødegård & Čapek"))) == "łodz ødegard and capek"
    assert [value(C.read_int(F.lit(t), 0, 10)) for t in ("7", "11", "x", "-1")] == [7, None, None, None]
    assert [value(C.plausible_phone(F.lit(t))) for t in ("07700 900123", "+1 415 555 2671", "12345", "call")] == [True, True, False, False]


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "=1+1", True), (1, 'a "b", c', None)], "id int, note string, ok boolean")
    C.write_csv(rows, f"file://{tmp_path}/out", order=["id"])
    text = "".join(open(f, encoding="utf-8", newline="").read() for f in sorted((tmp_path / "out").glob("part-*")))
    assert text.count("﻿id,note,ok\r\n") >= 1
    assert text.replace("﻿id,note,ok\r\n", "") == '1,"a ""b"", c",\r\n2,\'=1+1,yes\r\n'


def test_csv_import(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿ref;"full name";note\r\n1;Ann;"a; b\nc"\r\n2;Bo\r\n', encoding="utf-8")
    got = C.read_csv(spark, f"file://{tmp_path}/in.csv").orderBy("ref").collect()
    assert [(r.ref, r["full name"], r.note) for r in got] == [("1", "Ann", "a; b\nc"), ("2", "Bo", None)]


def test_scopes_and_tenants(spark):
    assert paging.sites_in_scope(None, None) is None and paging.sites_in_scope([1, 2], [2, 3]) == [2] and paging.sites_in_scope([], None) == []
    rows = spark.createDataFrame([(1, 1), (2, 2)], "tenant_id int, x int")
    assert records.of_tenant(rows, 2).count() == 1
    for args in ((rows.drop("tenant_id"), 1), (rows, None), (rows, "")):
        with pytest.raises(ValueError):
            records.of_tenant(*args)


def test_sources_can_be_taken_away(spark):
    s = opening.Sources(diary=lambda spark, sf: spark.range(3))
    figures = {"n": ("diary", F.count("*"))}
    assert tuple(s.report(spark, "", figures).first()) == ("n", True, 3.0)
    s.register("diary", None)
    assert tuple(s.report(spark, "", figures).first()) == ("n", False, None)


def test_episode_files_beyond_limits(spark):
    files = spark.createDataFrame([(1, '{"notes":[{"date":"2026-04-03"},{"date":"2026-04-04"}]}'), (2, ""), (3, None), (4, "[]")], "k long, content string")
    got = episodes.read_json(files, "k", most_notes=1)
    assert got["notes"].count() == 0
    assert {(r.k, r.code) for r in got["issues"].collect()} == {(1, "TOO_MANY_NOTES"), (2, "NOT_READABLE"), (3, "NOT_READABLE"), (4, "NOT_READABLE")}


def test_shared_folder_is_never_guessed_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        jobs.shared_folder(Session)
