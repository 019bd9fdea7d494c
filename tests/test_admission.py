"""Admission against a plain reading of arrivals one by one."""

import random

import pytest

from wardflow.operators.admission import admit, chains
from wardflow.operators.intervals import DAY_US

HOUR = 3_600_000_000


def one_by_one(rows):
    out, entered, holds = {}, [], []
    for item, room, arrival, s, e, until, who in sorted(rows, key=lambda r: (r[2], r[0])):
        if room is None or s is None or e is None or s >= e:
            out[item] = None if until is not None else True
            continue
        if until is not None:
            holds.append((room, s, e, until, who))
            out[item] = None
            continue
        clash = any(r == room and a < e and b > s for r, a, b in entered) or any(r == room and a < e and b > s and u > arrival and (who is None or who != w) for r, a, b, u, w in holds)
        out[item] = not clash
        if not clash:
            entered.append((room, s, e))
    return out


@pytest.mark.parametrize("seed, rooms", [(1, 1), (2, 4), (3, 2)])
def test_bookings(spark, seed, rooms):
    rng = random.Random(seed)
    rows = []
    for item in range(400):
        s = rng.randrange(6 * 24) * HOUR // 2
        room = rng.choice([*range(rooms), 0, None]) if rng.random() < 0.1 else 0 if rng.random() < 0.5 else rng.randrange(rooms)  # half in one room
        e = s + rng.choice([0, 1, 1, 2, 3, 30]) * HOUR // 2
        rows.append((item, room, rng.randrange(150), s if rng.random() > 0.02 else None, e, rng.randrange(200) if rng.random() < 0.15 else None, rng.choice([None, 1, 2, 3])))
    df = spark.createDataFrame(rows, "item long, room long, arrival long, s long, e long, until long, patient long").repartition(5)
    got = {r.item: r.admitted for r in admit(df, "room", "item").collect()}
    assert got == one_by_one(rows)
    assert {True, False, None} <= set(got.values())


def test_days_are_chained_by_what_crosses_midnight(spark):
    d = DAY_US
    rows = [(1, 0, d // 2), (1, d - HOUR, d + HOUR), (1, 3 * d, 3 * d + HOUR), (1, 4 * d - HOUR, 4 * d), (1, 4 * d, 4 * d + HOUR), (2, 0, 3 * d)]
    got = {(r.room, r.day_no): r.chain for r in chains(spark.createDataFrame(rows, "room long, s long, e long"), "room").collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 3): 2, (1, 4): 3, (2, 0): 1, (2, 1): 1, (2, 2): 1}


def test_no_rows(spark):
    assert admit(spark.createDataFrame([], "item long, room long, arrival long, s long, e long, until long, patient long"), "room", "item").count() == 0
