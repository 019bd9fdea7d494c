"""Checks of records by hand; code search and spans against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardflow.operators.record_checks import anchors, record_checks, search_codes, shortest_span

D = dt.date


def test_all_eight_checks(spark):
    episodes = [(1, "discharged", None, None, None, "solicitor"), (2, "open", True, "accident", D(2024, 1, 1), "gp"), (3, "discharged", True, "fall", None, "gp"), (4, "discharged", False, None, None, "gp")]
    notes = [
        (1, 10, D(2024, 2, 1), "initial_assessment", "Elm", None, "neck pain"),
        (1, 11, D(2024, 2, 9), "review", "Oak ", None, "He missed his appointment"),
        (2, 20, D(2024, 2, 1), "initial_assessment", "Elm", "asthma", "x"),
        (2, 21, D(2024, 2, 2), "discharge", "ELM", None, None),
        (3, 30, D(2024, 2, 1), "review", None, None, "PMH nil"),
        (3, 31, None, "review", "Elm", None, "y"),
    ]
    visits = [(1, 100, D(2024, 2, 5), True, " "), (1, 101, D(2024, 2, 10), True, None), (1, 102, D(2024, 2, 11), True, "ill"), (2, 200, D(2024, 2, 5), False, None), (2, 201, D(2024, 2, 5), True, None)]
    series = [(1, "ndi", 1), (1, "odi", 2), (2, "ndi", 3), (9, "ndi", 1)]
    got = record_checks(
        spark.createDataFrame(episodes, "episode long, status string, consent boolean, incident string, incident_day date, referral string"),
        spark.createDataFrame(notes, "episode long, note_id long, day date, kind string, author string, history string, text string"),
        spark.createDataFrame(visits, "episode long, visit_id long, day date, missed boolean, reason string"),
        spark.createDataFrame(series, "episode long, series_id string, points long"),
    )
    assert sorted((r.episode, r.code, tuple(r.about)) for r in got.collect()) == sorted(
        [
            (1, "CONSENT_NOT_RECORDED", ()),
            (1, "NO_PRE_INCIDENT_HISTORY", ("10",)),
            (1, "DNA_WITHOUT_REASON", ("101",)),
            (1, "NO_DISCHARGE_NOTE", ("11",)),
            (1, "SINGLE_TIMEPOINT_OUTCOME", ("ndi",)),
            (1, "INCIDENT_DATE_MISSING", ()),
            (1, "MULTIPLE_CLINICIANS", ("11",)),
            (2, "EPISODE_STILL_OPEN", ()),
            (2, "DNA_WITHOUT_REASON", ("201",)),
            (3, "NO_DISCHARGE_NOTE", ("30",)),
            (3, "INCIDENT_DATE_MISSING", ()),
            (3, "MULTIPLE_CLINICIANS", ("30",)),
            (4, "CONSENT_NOT_RECORDED", ()),
            (4, "NO_DISCHARGE_NOTE", ()),
        ]
    )


def test_code_search(spark):
    rng = random.Random(4)
    words = ["neck", "pain", "of", "hip", "(whiplash)", "strain", "é", "ab"]
    codes = [(f"{rng.choice('MSG')}{rng.randint(10, 99)}.{rng.randint(0, 9)}", " ".join(rng.choices(words, k=rng.randint(1, 4))), k // 2) for k in range(80)]
    asked = ["m", "M5", "m54.", "s1", "neck pain", "pain  hip", "OF", "a", "hiplas", "  ", "", ".", "zz", "m1 x"]
    got = search_codes(spark.createDataFrame(codes, "code string, label string, place int"), spark.createDataFrame([(a,) for a in asked * 2], "asked string"), 5).collect()
    for a in asked:
        q = a.strip().lower()
        want = sorted({(place, code) for code, label, place in codes if code.lower().replace(".", "").startswith(q.replace(".", "")) or all(w in label.lower() for w in q.split())})[:5]
        assert [r.code for r in sorted((r for r in got if r.asked == a), key=lambda r: r["rank"])] == [c for _, c in want], a


def test_shortest_spans(spark):
    rng = random.Random(6)
    rows = [(k, [(i, w) for i, w in enumerate(rng.choices("abcde", k=rng.randint(0, 25)))], rng.sample("abcdef", rng.randint(1, 3))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, places array<struct<place: int, stem: string>>, wanted array<string>")
    for r in df.select("k", shortest_span(F.col("places"), F.col("wanted")).alias("s")).collect():
        _, places, wanted = rows[r.k]
        text = [w for _, w in places]
        spans = [(b - a, b, a) for a in range(len(text)) for b in range(a, len(text)) if set(wanted) <= set(text[a : b + 1])]
        assert (r.s and (r.s.first, r.s.last)) == (min(spans)[2:0:-1] if spans else None)


def test_anchors(spark):
    claims = [(1, 0, "walked dogs"), (1, 1, "never said"), (1, 2, "..."), (2, 3, "walked dogs")]
    sources = [(1, 7, "Dogs are walked and dogs walk"), (1, 8, "He walks"), (2, 9, "cats")]
    got = anchors(spark.createDataFrame(claims, "k int, claim int, text string"), spark.createDataFrame(sources, "k int, source int, text string"), "k").collect()
    assert [tuple(r) for r in got] == [(1, 0, 7, 4, 5)]  # "dogs walk"
