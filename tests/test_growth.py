"""Work that grows with the input: values read once a row, rules alike compared once, pairs of texts sieved before they leave a task."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wardflow import registry
from wardflow.operators import cleaning, intervals, set_join, statements


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("read", [cleaning.read_date, cleaning.read_time, cleaning.money_pence, statements.quoted_duration, statements.band])
def test_a_text_is_read_once(spark, read):
    """The text's own expression stands once in the plan, not once for every use of what is read from it."""
    rows = spark.range(3).select(read(F.reverse(F.col("id").cast("string"))).alias("v"))
    assert plan(rows).count("reverse(") == 1


def test_options_are_read_before_the_rows(spark):
    rows = spark.range(3).select(F.struct(F.col("id").cast("double").alias("low"), F.lit(None).cast("double").alias("high")).alias("d"))
    shown = rows.select(statements.band_containing(F.col("d"), ["0-3 months", "Over 12 months", "soon"]).alias("band"))
    assert "regexp" not in plan(shown)


def test_rules_alike_are_one_class(spark, sf, tmp_path):
    """Four copies of every rule: sixteen pairs for each, and six within each class, from the same classes."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    base = {(r.a, r.b) for r in registry.queries()["rota_clashes"](spark, sf).collect()}
    n = 1260  # after so many keys the made-up rules come again
    copies = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("s_suppkey", F.col("s_suppkey") + n * F.col("k")).drop("k")
    copies.write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.queries()["rota_clashes"](spark, str(tmp_path))
    got = df.collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(got) == len(pairs) and all(a < b for a, b in pairs)
    for a, b in base:
        assert {(min(a + n * i, b + n * j), max(a + n * i, b + n * j)) for i in range(4) for j in range(4)} <= pairs
    assert {(a % n, b % n) for a, b in pairs if a % n != b % n} == {p for a, b in base for p in ((a, b), (b, a))} & {(a % n, b % n) for a, b in pairs}
    assert "HashAggregate" in plan(df)


def test_unlike_sets_with_a_common_word_make_no_pair():
    """400 sets share one word of their prefix; only the two that are alike leave the task, and alike sets of every size do."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, int(n))) for n in rng.integers(5, 900, 400)]
    sets += [np.r_[s[: len(s) - len(s) // 10], rng.integers(-(2**63), 2**63 - 1, len(s) // 10)] for s in sets]
    rows = sorted((len(s), i, set_join.parity(s)) for i, s in enumerate(sets))
    batch = pa.RecordBatch.from_pydict({"x": pa.array([1] * len(rows), pa.int64()), "id": [r[1] for r in rows], "n": [r[0] for r in rows], "bits": [r[2] for r in rows]})
    found = {(min(a, b), max(a, b)) for o in set_join._met(0.8)(iter([batch])) for a, b in zip(o["a"].to_pylist(), o["b"].to_pylist())}
    want = {(i, i + 400) for i in range(400) if len(np.intersect1d(sets[i], sets[i + 400])) >= 0.8 * len(np.union1d(sets[i], sets[i + 400])) - 1e-9}
    assert want <= found and len(found) <= len(want) + 40 and len(want) > 300


def test_near_pairs_of_generated_sets(spark):
    rng, rows = random.Random(9), []
    for i in range(240):
        w = {f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice((3, 8, 30, 90)))}
        rows.append((3 * i, sorted(w)))
        rows.append((3 * i + 1, sorted((w - {min(w)}) | {"new"} if rng.random() < 0.5 else w | {"more"})))
    df = spark.createDataFrame(rows, "id long, w array<string>").groupBy("w").agg(F.min("id").alias("id"))
    kept = [(r.id, set(r.w)) for r in df.collect()]
    want = sorted((a, b) for a, x in kept for b, y in kept if a < b and len(x & y) / len(x | y) >= 0.8 - 1e-9)
    assert sorted((r.a, r.b) for r in set_join.near_pairs(df).collect()) == want and want


def test_table_function_runs_on_all_cores(spark, tmp_path):
    """A table in one small file doesn't make one task of the table function."""
    from wardflow.operators import paging

    spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    at = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(at)
    spark.conf.set(at, "false")
    try:
        out = paging.sql_table_function(spark, f"file://{tmp_path}")
        assert len({r.p for r in out.selectExpr("spark_partition_id() AS p").distinct().collect()}) > 1 and out.count() == 800
    finally:
        spark.conf.set(at, before)


def test_pairs_of_a_busy_slot_are_made_in_many_tasks(spark):
    """One key with 40,000 intervals within an hour, which are not broadcast."""
    at = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(at)
    spark.conf.set(at, "-1")
    try:
        rows = spark.range(40_000).selectExpr("id", "1 AS k", "id * 75000 AS s", "id * 75000 + 1250000 AS e")
        made = intervals.overlaps(rows, "k").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set(at, before)
    assert sum(r["count"] for r in made) == sum(min(16, 39_999 - i) for i in range(40_000))
    assert len(made) > 1


def test_overlaps_of_odd_intervals(spark):
    """Equal starts, empty and reversed intervals, ids that come twice, nulls, long intervals and times before 1970: as the SQL's condition says."""
    rng, rows = random.Random(4), []
    for i in range(300):
        s = rng.randrange(-60, 60)
        rows.append((rng.choice((i, i, i, i - 1)), rng.choice((1, 1, 2)), s, s + rng.choice((-3, 0, 1, 2, 5, 30))))
    rows += [rows[0], (None, 1, 0, 9), (900, None, 0, 9), (901, 1, None, 9), (902, 1, 0, None)]
    full = [r for r in rows if None not in r]
    want = sorted((k, a, b) for a, k, s, e in full for b, j, t, u in full if k == j and a < b and s < u and t < e)
    df = spark.createDataFrame(rows, "id long, k long, s long, e long")
    for block, blocks in ((2, 2), (256, 16)):
        assert sorted(map(tuple, intervals.overlaps(df, "k", 10, block, blocks).collect())) == want


def test_intervals_are_shuffled_once(spark):
    """Intervals and the starts that they run through read the same shuffle, to which each interval is sent once a slot."""
    df = intervals.overlaps(spark.range(2_000).selectExpr("id", "id % 3 AS k", "id * 75000 AS s", "id * 75000 + 1250000 AS e"), "k", 10_000_000)
    got = df.collect()
    ran = [line for line in plan(df).split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(k" in line]
    assert len(got) == sum(min(5, (1_999 - i) // 3) for i in range(2_000))
    assert sorted("ReusedExchange" in line for line in ran) == [False, True]


def test_overlaps_with_more_busy_slots_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BUSY_SLOTS", 1)
    rows = spark.range(600).selectExpr("id", "id % 2 AS k", "id * 5 AS s", "id * 5 + 40 AS e")
    got = sorted((r.a, r.b) for r in intervals.overlaps(rows, "k", 100, 2, 2).collect())
    assert got == [(i, j) for i in range(600) for j in range(i + 2, min(i + 8, 600), 2)]


def test_a_pair_leaves_few_of_the_words_that_it_shares():
    """Near copies share nearly all words of their prefixes; each pair leaves the task of one or two of them, not of all."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63 - 1, 150)
    sets = [np.unique(np.r_[base[rng.permutation(150)[:146]], rng.integers(-(2**63), 2**63 - 1, 4)]) for _ in range(60)]
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(60), pa.int64()), "h": pa.array(sets, pa.list_(pa.int64()))})
    none = SimpleNamespace(value=(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    sent = pa.Table.from_batches(set_join._entries(none, 0.8)(iter([rows]))).sort_by([("x", "ascending"), ("n", "ascending")]).combine_chunks()
    found = []
    for x in sent["x"].unique():
        found += [p for o in set_join._met(0.8)(iter(sent.filter(pc.equal(sent["x"], x)).to_batches())) for p in zip(o["a"].to_pylist(), o["b"].to_pylist())]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert want <= set(found) and len(want) > 1500 and len(found) <= 2 * len(want)


@pytest.mark.parametrize("narrow", [0, 2_000_000])
def test_near_pairs_of_a_crowd_in_cells(spark, monkeypatch, narrow):
    """A crowd of more sets than a cell holds, sets apart from it, and an id that comes with two sets: all pairs with their figures."""
    monkeypatch.setattr(set_join, "CELL", 7)
    monkeypatch.setattr(set_join, "NARROW", narrow)
    rng, words = random.Random(8), [f"w{i}" for i in range(40)]
    rows = [(i, sorted(set(words) - set(rng.sample(words, 3)) | {f"own{i}"})) for i in range(60)] + [(100 + i, [f"far{i}", "w1", "w2"]) for i in range(9)]
    rows += [(3, sorted({*words, "twin"})), (200, ["single"]), (201, ["single", "b"])]
    got = sorted(map(tuple, set_join.near_pairs(spark.createDataFrame(rows, "id long, w array<string>")).collect()))
    want = []
    for p, (i, x) in enumerate(rows):
        for j, y in rows[p + 1 :]:
            both = len(set(x) & set(y))
            if i != j and both / (len(x) + len(y) - both) >= 0.8 - 1e-9:
                want.append((min(i, j), max(i, j), both, both / (len(x) + len(y) - both)))
    assert got == sorted(want) and len(want) > 1000
