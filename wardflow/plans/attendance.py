"""Attendance, utilisation and patient reports over appointments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import appointments, sql

OUTCOMES = ("attended", "dna", "late_cancelled", "upcoming", "unrecorded")
PERIOD = ("2024-01-08", "2024-01-28")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null without a positive whole."""
    return F.when(whole > 0, part / whole)


def attendance(appts: DataFrame, *by: str) -> DataFrame:
    """Counts of each outcome, what was due, and rates of what was due, for each value of `by`."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    rows = appts.groupBy(*by).agg(*counts, F.count("*").alias("bookings"), F.sum("minutes").alias("minutes"))
    due = F.col("attended") + F.col("dna") + F.col("late_cancelled")
    return rows.withColumn("due", due).withColumns({"attended_rate": ratio(F.col("attended"), F.col("due")), "dna_rate": ratio(F.col("dna"), F.col("due")), "late_rate": ratio(F.col("late_cancelled"), F.col("due"))})


def series(spark: SparkSession, first: str, last: str, step: str, name: str) -> DataFrame:
    """One row for each step of a period, so that empty ones show."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{first}', DATE'{last}', INTERVAL {step})")).alias(name))


_FIGURES = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in OUTCOMES) + ", count(*) AS bookings, CAST(sum(minutes) AS BIGINT) AS minutes"
_RATES = "CASE WHEN due > 0 THEN attended / due END AS attended_rate, CASE WHEN due > 0 THEN dna / due END AS dna_rate, CASE WHEN due > 0 THEN late_cancelled / due END AS late_rate"


def _oracle(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return sql("appts", f"SELECT *, {_RATES} FROM (SELECT *, attended + dna + late_cancelled AS due FROM (SELECT {by}{_FIGURES} FROM appts" + (f" GROUP BY {keys}" if keys else "") + "))")


@query(_oracle(""))
def attendance_total(spark, sf_dir):
    return attendance(appointments(spark, sf_dir))


@query(_oracle("site_id"))
def attendance_by_site(spark, sf_dir):
    return attendance(appointments(spark, sf_dir), "site_id")


@query(_oracle("practitioner_id"))
def attendance_by_practitioner(spark, sf_dir):
    return attendance(appointments(spark, sf_dir), "practitioner_id")


@query(sql("appts", "SELECT strftime(day, '%Y-%m') AS month, site_id, outcome, count(*) AS appointments, CAST(sum(minutes) AS BIGINT) AS minutes FROM appts GROUP BY ALL"))
def attendance_by_month(spark, sf_dir):
    """Appointment facts by month, site and outcome."""
    return appointments(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month"), "site_id", "outcome").agg(F.count("*").alias("appointments"), F.sum("minutes").alias("minutes"))


@query(sql("appts", """, weeks AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-12', INTERVAL 7 DAY)) AS DATE) AS week),
n AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) FILTER (outcome = 'attended') AS attended, count(*) AS bookings FROM appts GROUP BY 1)
SELECT week, coalesce(attended, 0) AS attended, coalesce(bookings, 0) AS bookings FROM weeks LEFT JOIN n USING (week)"""))
def attendance_by_week(spark, sf_dir):
    """Every Monday of the period, with zeros where nothing was booked."""
    n = appointments(spark, sf_dir).groupBy(F.trunc("day", "week").alias("week")).agg(F.count_if(F.col("outcome") == "attended").alias("attended"), F.count("*").alias("bookings"))
    return series(spark, "2023-12-25", "2024-02-12", "7 DAYS", "week").join(n, "week", "left").fillna(0, ["attended", "bookings"])


def visit_facts_of(appts: DataFrame) -> DataFrame:
    """Attended visits; first_visit marks a patient's first attended instant, ties included. A patient's first instant
    comes from a pre-aggregated join, not a window, so that no patient's rows meet in one task."""
    seen = appts.where("outcome = 'attended'")
    first = seen.groupBy("patient_id").agg(F.min("starts_us").alias("first_us"))
    return seen.join(first, "patient_id").withColumn("first_visit", F.col("starts_us") == F.col("first_us"))


_SEEN = ", seen AS (SELECT *, starts_us = min(starts_us) OVER (PARTITION BY patient_id) AS first_visit FROM appts WHERE outcome = 'attended')\n"


@query(sql("appts", _SEEN + "SELECT day, site_id, practitioner_id, first_visit, count(*) AS appointments FROM seen GROUP BY ALL"))
def visit_facts(spark, sf_dir):
    return visit_facts_of(appointments(spark, sf_dir)).groupBy("day", "site_id", "practitioner_id", "first_visit").agg(F.count("*").alias("appointments"))


@query(sql("appts", _SEEN + f", f AS (SELECT patient_id, min(day) AS first_day, max(CASE WHEN day BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}' THEN 1 ELSE 0 END) AS inside FROM seen GROUP BY 1)\nSELECT count(*) AS patients, count(*) FILTER (first_day >= DATE '{PERIOD[0]}') AS new_patients FROM f WHERE inside = 1"))
def attended_patients(spark, sf_dir):
    """Patients seen in the period, and those of them never seen before it."""
    inside = F.col("day").between(F.lit(PERIOD[0]).cast("date"), F.lit(PERIOD[1]).cast("date"))
    per = appointments(spark, sf_dir).where("outcome = 'attended'").groupBy("patient_id").agg(F.min("day").alias("first_day"), F.max(inside).alias("inside")).where("inside")
    return per.agg(F.count("*").alias("patients"), F.count_if(F.col("first_day") >= F.lit(PERIOD[0]).cast("date")).alias("new_patients"))


@query("SELECT strftime(first_on, '%Y-%m') AS month, count(*) AS new_patients FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_on FROM orders GROUP BY 1) GROUP BY 1")
def new_by_month(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_on"))
    return first.groupBy(F.date_format("first_on", "yyyy-MM").alias("month")).agg(F.count("*").alias("new_patients"))


@query("""WITH v AS (SELECT DISTINCT o_custkey AS p, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders), f AS (SELECT p, min(week) AS first_week FROM v GROUP BY 1)
SELECT week, count(*) FILTER (week = first_week) AS new_patients, count(*) FILTER (week > first_week) AS returning_patients FROM v JOIN f USING (p) GROUP BY week""")
def new_returning_by_week(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("p"), F.trunc(F.to_date("o_orderdate"), "week").alias("week")).distinct()
    first = v.groupBy("p").agg(F.min("week").alias("first_week"))
    return v.join(first, "p").groupBy("week").agg(F.count_if(F.col("week") == F.col("first_week")).alias("new_patients"), F.count_if(F.col("week") > F.col("first_week")).alias("returning_patients"))


@query(sql("appts", """, tagged AS (SELECT site_id, outcome, CASE WHEN day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' THEN 'now' WHEN day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 'before' END AS period FROM appts)
SELECT site_id, count(*) FILTER (period = 'now') AS now_attended, count(*) FILTER (period = 'before') AS before_attended FROM tagged WHERE outcome = 'attended' AND period IS NOT NULL GROUP BY 1"""))
def period_comparison(spark, sf_dir):
    """A week against the one before, in one scan."""
    a = appointments(spark, sf_dir).where("outcome = 'attended' AND day BETWEEN DATE'2024-01-08' AND DATE'2024-01-21'")
    now = F.col("day") >= F.lit("2024-01-15").cast("date")
    return a.groupBy("site_id").agg(F.count_if(now).alias("now_attended"), F.count_if(~now).alias("before_attended"))


@query(sql("appts", """, visits AS (SELECT patient_id, starts_us, lag(starts_us) OVER (PARTITION BY patient_id ORDER BY starts_us, appointment_id) AS before_us FROM appts WHERE outcome = 'attended')
SELECT patient_id, count(*) AS visits, CAST(max(starts_us - before_us) AS BIGINT) AS longest_gap_us FROM visits GROUP BY 1"""))
def episode_facts(spark, sf_dir):
    """Visits and the longest gap between visits of each patient."""
    w = Window.partitionBy("patient_id").orderBy("starts_us", "appointment_id")
    v = appointments(spark, sf_dir).where("outcome = 'attended'").select("patient_id", (F.col("starts_us") - F.lag("starts_us").over(w)).alias("gap"))
    return v.groupBy("patient_id").agg(F.count("*").alias("visits"), F.max("gap").alias("longest_gap_us"))
