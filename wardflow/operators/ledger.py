"""Ledgers: running balances, oldest-first allocation, shares of an excess, greedy course matching, numbering."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import appointments, invoices, sql, table


def running_balance(entries: DataFrame, account: str, *order: str) -> DataFrame:
    """Adds balance_pence: the sum of amount_pence up to and with each entry of its account."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("balance_pence", F.sum("amount_pence").over(w))


@query(sql("invoices", """, e AS (SELECT patient_id, issued_on AS day, 0 AS kind_order, invoice_id, total_pence AS amount_pence FROM invoices
UNION ALL SELECT patient_id, due_on, 1, invoice_id, -paid_pence FROM invoices WHERE paid_pence > 0)
SELECT patient_id, day, kind_order, invoice_id, amount_pence, CAST(sum(amount_pence) OVER (PARTITION BY patient_id ORDER BY day, kind_order, invoice_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_pence FROM e"""))
def statement_running_balance(spark, sf_dir):
    bills = invoices(spark, sf_dir)
    charged = bills.select("patient_id", F.col("issued_on").alias("day"), F.lit(0).alias("kind_order"), "invoice_id", F.col("total_pence").alias("amount_pence"))
    paid = bills.where("paid_pence > 0").select("patient_id", F.col("due_on").alias("day"), F.lit(1).alias("kind_order"), "invoice_id", (-F.col("paid_pence")).alias("amount_pence"))
    return running_balance(charged.unionByName(paid), "patient_id", "day", "kind_order", "invoice_id")


def allocate_oldest_first(open_rows: DataFrame, account: str, amount: str, *order: str) -> DataFrame:
    """Adds taken_pence: what a payment of `amount` gives each open balance, oldest first."""
    before = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(amount) - F.coalesce(F.sum("balance_pence").over(before), F.lit(0))
    return open_rows.withColumn("taken_pence", F.greatest(F.lit(0), F.least(F.col("balance_pence"), left)))


@query(sql("invoices", """, o AS (SELECT *, 5000000 AS payment_pence, coalesce(sum(balance_pence) OVER (PARTITION BY patient_id ORDER BY issued_on, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM invoices WHERE balance_pence > 0)
SELECT patient_id, invoice_id, balance_pence, CAST(greatest(0, least(balance_pence, payment_pence - before)) AS BIGINT) AS taken_pence FROM o"""))
def auto_allocate(spark, sf_dir):
    """A payment of 50,000.00 by each patient."""
    rows = invoices(spark, sf_dir).where("balance_pence > 0").withColumn("payment_pence", F.lit(5_000_000).cast("long"))
    return allocate_oldest_first(rows, "patient_id", "payment_pence", "issued_on", "invoice_id").select("patient_id", "invoice_id", "balance_pence", "taken_pence")


@query("""WITH l AS (SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS charged_pence FROM lineitem),
b AS (SELECT *, coalesce(sum(charged_pence) OVER (PARTITION BY invoice_id ORDER BY line_no, charged_pence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT invoice_id, line_no, charged_pence, CAST(greatest(0, least(charged_pence, 2500000 - before)) AS BIGINT) AS case_share_pence, least(charged_pence, 5000) AS visit_share_pence FROM b""")
def patient_shares(spark, sf_dir):
    """A patient's share of each line: an excess of 25,000.00 a case, first lines first, and one of 50.00 a visit."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("charged_pence"))
    shared = allocate_oldest_first(lines.withColumns({"balance_pence": F.col("charged_pence"), "excess": F.lit(2_500_000).cast("long")}), "invoice_id", "excess", "line_no", "charged_pence")
    return shared.select("invoice_id", "line_no", "charged_pence", F.col("taken_pence").alias("case_share_pence"), F.least(F.col("charged_pence"), F.lit(5_000).cast("long")).alias("visit_share_pence"))


def match_courses(visits: DataFrame, courses: DataFrame) -> DataFrame:
    """Gives each visit (patient_id, visit_id, day) the earliest-expiring course of its patient (course_id, starts_on,
    expires_on, sessions) that covers the day and has sessions left. Columns: patient_id, visit_id, course_id (null: none).

    A choice depends on the choices before it, so no window can say it. Both kinds of rows are put in order of patient and
    day (courses before visits) and read as a stream: the courses open at a day are a heap by expiry, and neither a
    patient's visits nor all of the patient's courses are ever held at once.
    """
    day = lambda c: F.unix_date(c).cast("long")
    opened = courses.select("patient_id", day("starts_on").alias("day"), F.lit(0).alias("kind"), F.col("course_id").alias("id"), day("expires_on").alias("expires"), F.col("sessions").cast("long").alias("sessions"))
    seen = visits.select("patient_id", day("day").alias("day"), F.lit(1).alias("kind"), F.col("visit_id").alias("id"), F.lit(None).cast("long").alias("expires"), F.lit(None).cast("long").alias("sessions"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, heap = None, []
        for batch in batches:
            out: list[tuple] = []
            for patient, day_no, kind, id_, expires, sessions in zip(*(batch.column(c).to_pylist() for c in ("patient_id", "day", "kind", "id", "expires", "sessions")), strict=True):
                if patient != who:
                    who, heap = patient, []
                if kind == 0:
                    if sessions > 0:
                        heapq.heappush(heap, [expires, id_, sessions])
                    continue
                while heap and heap[0][0] < day_no:
                    heapq.heappop(heap)
                out.append((patient, id_, heap[0][1] if heap else None))
                if heap:
                    heap[0][2] -= 1
                    if not heap[0][2]:
                        heapq.heappop(heap)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["patient_id", "visit_id", "course_id"])

    rows = opened.unionByName(seen).withColumns({"patient_id": F.col("patient_id").cast("long"), "id": F.col("id").cast("long")})
    return rows.repartition("patient_id").sortWithinPartitions("patient_id", "day", "kind", "id").mapInArrow(greedy, "patient_id long, visit_id long, course_id long")


_GREEDY = sql("appts", """, v AS (SELECT patient_id, appointment_id AS visit_id, day, row_number() OVER (PARTITION BY patient_id ORDER BY day, appointment_id) AS r FROM appts WHERE outcome = 'attended'),
c AS (SELECT patient_id, list({'e': day + 9, 'id': appointment_id, 's': day} ORDER BY day + 9, appointment_id) AS cs FROM appts WHERE status = 'booked' GROUP BY 1),
s AS (SELECT v.patient_id, CAST(0 AS BIGINT) AS r, list_transform(range(coalesce(len(cs), 0)), lambda i: CAST(3 AS BIGINT)) AS rest, CAST(NULL AS BIGINT) AS visit_id, CAST(NULL AS BIGINT) AS course_id FROM (SELECT DISTINCT patient_id FROM v) v LEFT JOIN c USING (patient_id)
UNION ALL SELECT patient_id, r, list_transform(range(1, len(rest) + 1), lambda i: rest[i] - CASE WHEN i = k THEN 1 ELSE 0 END), visit_id, cs[k].id
FROM (SELECT s.patient_id, v.r, s.rest, v.visit_id, c.cs, list_filter(range(1, len(s.rest) + 1), lambda i: s.rest[i] > 0 AND c.cs[i].s <= v.day AND v.day <= c.cs[i].e)[1] AS k FROM s JOIN v ON v.patient_id = s.patient_id AND v.r = s.r + 1 LEFT JOIN c ON c.patient_id = s.patient_id))
SELECT patient_id, visit_id, course_id FROM s WHERE r > 0""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_GREEDY)
def greedy_courses(spark, sf_dir):
    """Attended visits against courses: every signup starts one of 3 sessions that lasts 10 days."""
    a = appointments(spark, sf_dir)
    visits = a.where("outcome = 'attended'").select("patient_id", F.col("appointment_id").alias("visit_id"), "day")
    courses = a.where("status = 'booked'").select("patient_id", F.col("appointment_id").alias("course_id"), F.col("day").alias("starts_on"), F.date_add("day", 9).alias("expires_on"), F.lit(3).alias("sessions"))
    return match_courses(visits, courses)


@query(sql("invoices", "SELECT site_id, invoice_id, row_number() OVER (PARTITION BY site_id, strftime(issued_on, '%Y-%m') ORDER BY issued_on, invoice_id) AS number_seq, strftime(issued_on, '%Y-%m') AS month FROM invoices"))
def document_numbers(spark, sf_dir):
    """Numbers of documents by site and month. Documents are numbered within their day, and days carry on from the counts of
    the days before, so that no task holds a site's month."""
    bills = invoices(spark, sf_dir).select("site_id", "invoice_id", "issued_on", F.date_format("issued_on", "yyyy-MM").alias("month"))
    days = bills.groupBy("site_id", "month", "issued_on").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.partitionBy("site_id", "month").orderBy("issued_on")) - F.col("n"))
    own = bills.withColumn("own", F.row_number().over(Window.partitionBy("site_id", "month", "issued_on").orderBy("invoice_id")))
    met = own.join(before.select(F.col("site_id").alias("s"), F.col("issued_on").alias("d"), "before"), F.col("site_id").eqNullSafe(F.col("s")) & (F.col("issued_on") == F.col("d")))
    return met.select("site_id", "invoice_id", (F.col("own") + F.col("before")).alias("number_seq"), "month")
