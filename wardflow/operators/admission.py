"""Admission of bookings that conflict: in order of arrival, one enters only if nothing that entered before it overlaps it.

A booking depends on those before it, so a resource's bookings are read as one sorted stream, but only as far as they can meet: days
that no interval joins are streams of their own. Days are counted before they are chained, so a busy resource is many small streams. A stream keeps the
admitted intervals in order of time; they never overlap, so each arrival looks at two neighbours.

A held offer is a row with `until`: from its arrival until then, it keeps its time for its patient and turns others away. Holds don't turn each other away.

Defined cases: an interval that ends where another begins doesn't overlap it; empty intervals and those without a resource or a time meet nothing and
enter; of equal arrivals the smaller id is first; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators.intervals import DAY_US
from wardflow.registry import query
from wardflow.sources.tables import appointments, sql


def chains(rows: DataFrame, *key: str) -> DataFrame:
    """(key, day_no, chain): the days of each key that intervals (s, e) touch; days with one chain are joined by intervals over midnight."""
    first, last = F.floor(F.col("s") / DAY_US), F.floor((F.col("e") - 1) / DAY_US)
    days = rows.select(*key, F.explode(F.sequence(first, last)).alias("day_no"), last.alias("last")).withColumn("goes_on", F.col("day_no") < F.col("last"))
    joined = days.groupBy(*key, "day_no").agg(F.max("goes_on").alias("goes_on"))
    order = Window.partitionBy(*key).orderBy("day_no")
    new = F.when(F.coalesce(F.lag("goes_on").over(order), F.lit(False)), 0).otherwise(1)
    return joined.withColumn("new", new).withColumn("chain", F.sum("new").over(order)).select(*key, "day_no", "chain")


class _Taken:
    """Admitted intervals in order, none of which overlap; and the holds in force."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: dict[int, int] = {}
        self.holds: list[tuple[int, int, int, int | None]] = []

    def admit(self, at: int, s: int, e: int, who: int | None) -> bool:
        i = bisect_left(self.starts, e) - 1
        if i >= 0 and self.ends[self.starts[i]] > s:
            return False
        self.holds = [h for h in self.holds if h[0] > at]
        if any(a < e and b > s and (who is None or who != patient) for _, a, b, patient in self.holds):
            return False
        insort(self.starts, s)
        self.ends[s] = e
        return True


def admit(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Adds to rows (item, key, arrival, s, e, until, patient) whether each is admitted: true or false, null for a hold. Times are whole numbers, arrival and until of one clock."""
    met = rows.where((F.col("s") < F.col("e")) & F.col(key).isNotNull())
    placed = met.withColumn("day_no", F.floor(F.col("s") / DAY_US)).join(chains(met, key), [key, "day_no"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, taken = None, _Taken()
        for batch in batches:
            out = []
            for at, chain, arrival, s, e, until, patient in zip(*(batch.column(c).to_pylist() for c in (key, "chain", "arrival", "s", "e", "until", "patient")), strict=True):
                if (at, chain) != stream:
                    stream, taken = (at, chain), _Taken()
                if until is None:
                    out.append(taken.admit(arrival, s, e, patient))
                else:
                    taken.holds.append((until, s, e, patient))
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(out, pa.bool_())], [item, "admitted"])

    stream = placed.select(item, key, "chain", "arrival", "s", "e", "until", "patient").repartition(key, "chain").sortWithinPartitions(key, "chain", "arrival", item)
    decided = stream.mapInArrow(decide, f"`{item}` {rows.schema[item].dataType.simpleString()}, admitted boolean")
    free = rows.where(~F.coalesce((F.col("s") < F.col("e")) & F.col(key).isNotNull(), F.lit(False)))
    return decided.unionByName(free.select(item, F.when(F.col("until").isNull(), True).alias("admitted")))


_ASKED = "SELECT appointment_id, practitioner_id AS who, appointment_id * 7919 % 100003 AS arrival, starts_us AS s, starts_us + (ends_us - starts_us) * 4 AS e, patient_id, CASE WHEN appointment_id % 10 = 3 THEN appointment_id * 7919 % 100003 + 20000 END AS until FROM appts"


@query(sql("appts", "SELECT 1").replace("\nSELECT 1", f""", asked AS ({_ASKED}),
days AS (SELECT DISTINCT who, unnest(range(s // {DAY_US}, (e - 1) // {DAY_US} + 1)) AS day_no FROM asked),
crossed AS (SELECT DISTINCT who, unnest(range(s // {DAY_US} + 1, (e - 1) // {DAY_US} + 1)) AS day_no FROM asked),
chained AS (SELECT d.who, d.day_no, sum(CASE WHEN c.day_no IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY d.who ORDER BY d.day_no) AS chain FROM days d LEFT JOIN crossed c ON c.who = d.who AND c.day_no = d.day_no),
ordered AS (SELECT a.*, chain, row_number() OVER (PARTITION BY a.who, chain ORDER BY arrival, appointment_id) AS k FROM asked a JOIN chained c ON c.who = a.who AND c.day_no = a.s // {DAY_US}),
steps AS (
  SELECT o.who, chain, 1::BIGINT AS k, appointment_id, CASE WHEN until IS NULL THEN true END AS admitted, CASE WHEN until IS NULL THEN [{{'s': s, 'e': e}}] ELSE [] END AS taken, CASE WHEN until IS NULL THEN [] ELSE [{{'s': s, 'e': e, 'until': until, 'p': patient_id}}] END AS holds FROM ordered o WHERE k = 1
  UNION ALL
  SELECT o.who, o.chain, o.k, o.appointment_id, x.ok, CASE WHEN x.ok THEN list_append(p.taken, {{'s': o.s, 'e': o.e}}) ELSE p.taken END, CASE WHEN o.until IS NULL THEN p.holds ELSE list_append(p.holds, {{'s': o.s, 'e': o.e, 'until': o.until, 'p': o.patient_id}}) END
  FROM steps p JOIN ordered o ON o.who = p.who AND o.chain = p.chain AND o.k = p.k + 1,
  LATERAL (SELECT CASE WHEN o.until IS NULL THEN len(list_filter(p.taken, lambda t: t.s < o.e AND t.e > o.s)) = 0 AND len(list_filter(p.holds, lambda h: h.s < o.e AND h.e > o.s AND h.until > o.arrival AND h.p <> o.patient_id)) = 0 END AS ok) x)
SELECT appointment_id, admitted FROM steps""").replace("WITH ", "WITH RECURSIVE ", 1))
def admitted_bookings(spark, sf_dir):
    """Appointments, made four times as long and asked for out of order, that enter a practitioner's diary; every tenth is a held offer."""
    asked = appointments(spark, sf_dir).select("appointment_id", F.col("practitioner_id").alias("who"), (F.col("appointment_id") * 7919 % 100003).alias("arrival"), F.col("starts_us").alias("s"), (F.col("starts_us") + (F.col("ends_us") - F.col("starts_us")) * 4).alias("e"), F.col("patient_id").alias("patient"))
    return admit(asked.withColumn("until", F.when(F.col("appointment_id") % 10 == 3, F.col("arrival") + 20_000)), "who", "appointment_id")
