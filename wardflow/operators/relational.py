"""Relational shapes: semi and anti joins, HAVING, outer lookups, top-k, keyset pages, distinct counts, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import NOW, appointments, invoices, micros, sql, table


def site_filter(column: str, sites: list | None) -> Column:
    """None: all sites; an empty list: none; else the sites named."""
    return F.lit(True) if sites is None else F.col(column).isin(sites) if sites else F.lit(False)


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The rows after a cursor, one more than a page, so that the caller knows if there is a next one."""
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            past, same = past | (same & (F.col(c) > F.lit(v))), same & (F.col(c) == F.lit(v))
        df = df.where(past)
    return df.orderBy(*order).limit(size + 1)


def search_filter(text: str, **columns: str) -> Column:
    """The predicate that a search text asks for: a mail part, a number, or words that must all occur."""
    text = text.strip().lower()
    if "@" in text:
        return F.lower(columns["email"]).contains(text)
    if text.isdigit():
        return F.col(columns["number"]).cast("string").startswith(text)
    out = F.lit(True)
    for word in text.split()[:5]:
        out = out & F.lower(columns["name"]).contains(word)
    return out


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
def semi_join_sites(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    return table(spark, sf_dir, "supplier").join(rich, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query(sql("appts", f"SELECT patient_id, count(*) AS visits FROM appts a WHERE NOT EXISTS (SELECT 1 FROM appts b WHERE b.patient_id = a.patient_id AND b.starts_us >= epoch_us(TIMESTAMP '{NOW}') AND b.status = 'booked') GROUP BY 1"))
def anti_no_future(spark, sf_dir):
    a = appointments(spark, sf_dir)
    future = a.where((F.col("starts_us") >= micros(F.lit(NOW).cast("timestamp_ntz"))) & (F.col("status") == "booked")).select("patient_id").distinct()
    return a.groupBy("patient_id").agg(F.count("*").alias("visits")).join(future, "patient_id", "left_anti")


@query(sql("invoices", "SELECT patient_id, CAST(sum(balance_pence) AS BIGINT) AS owed_pence FROM invoices GROUP BY 1 HAVING sum(balance_pence) > 0"))
def having_owes(spark, sf_dir):
    return invoices(spark, sf_dir).groupBy("patient_id").agg(F.sum("balance_pence").alias("owed_pence")).where("owed_pence > 0")


@query("SELECT c_custkey, coalesce(n_name, 'Unknown site') AS site, coalesce(r_name, 'No region') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join_directory(spark, sf_dir):
    """Names of a directory (nations and regions), with words for what is missing; the planner broadcasts it as long as it is small."""
    n, r = table(spark, sf_dir, "nation").where("n_nationkey < 20"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("Unknown site")).alias("site"), F.coalesce("r_name", F.lit("No region")).alias("region"))


@query("SELECT l_suppkey AS referrer_id, count(*) AS referrals, s_name AS name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL ORDER BY referrals DESC, referrer_id LIMIT 100")
def topn_sources(spark, sf_dir):
    """The 100 sources that refer most; names are joined to those only."""
    top = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("referrer_id")).agg(F.count("*").alias("referrals")).orderBy(F.desc("referrals"), "referrer_id").limit(100)
    return top.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("referrer_id"), F.col("s_name").alias("name")), "referrer_id", "left")


@query(sql("appts", "SELECT starts_us, appointment_id, patient_id FROM appts WHERE starts_us > 1705276800000000 OR (starts_us = 1705276800000000 AND appointment_id > 5) ORDER BY starts_us, appointment_id LIMIT 51"))
def keyset_page_of_appointments(spark, sf_dir):
    """A page of 50 after a cursor, and one row more."""
    return keyset_page(appointments(spark, sf_dir).select("starts_us", "appointment_id", "patient_id"), ["starts_us", "appointment_id"], (1705276800000000, 5), 50)


@query(sql("appts", "SELECT day, count(DISTINCT patient_id) AS patients, count(DISTINCT practitioner_id) AS practitioners FROM appts GROUP BY 1"))
def distinct_count(spark, sf_dir):
    return appointments(spark, sf_dir).groupBy("day").agg(F.countDistinct("patient_id").alias("patients"), F.countDistinct("practitioner_id").alias("practitioners"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer') AND contains(lower(c_name), '7') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def patient_filter(spark, sf_dir):
    found = search_filter("Customer 7x".replace("x", ""), name="c_name", number="c_custkey", email="c_name")
    return table(spark, sf_dir, "customer").where(found & site_filter("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey", "c_name")


@query(sql("appts", "SELECT practitioner_id, count(*) FILTER (status = 'attended') AS attended, count(*) FILTER (status = 'arrived') AS arrived, count(*) FILTER (status = 'dna') AS dna, count(*) FILTER (status = 'late_cancelled') AS late_cancelled, count(*) FILTER (status = 'booked') AS booked FROM appts GROUP BY 1"))
def status_counts(spark, sf_dir):
    """Counts pivoted on a fixed list of statuses."""
    return appointments(spark, sf_dir).groupBy("practitioner_id").pivot("status", ["attended", "arrived", "dna", "late_cancelled", "booked"]).agg(F.count(F.lit(1))).fillna(0)


@query(sql("appts", "SELECT patient_id, max(appointment_id) FILTER (l = 1) AS latest_id, max(appointment_id) FILTER (f = 1) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY starts_us DESC, appointment_id DESC) AS l, row_number() OVER (PARTITION BY patient_id ORDER BY starts_us, appointment_id) AS f FROM appts) GROUP BY 1"))
def first_and_latest(spark, sf_dir):
    """First and latest appointment of each patient, without sorting anyone's rows."""
    at = F.struct("starts_us", "appointment_id")
    return appointments(spark, sf_dir).groupBy("patient_id").agg(F.max(at)["appointment_id"].alias("latest_id"), F.min(at)["appointment_id"].alias("first_id"))


@query(sql("appts", """, r AS (SELECT * FROM appts WHERE status = 'arrived'), s AS (SELECT * FROM appts WHERE status = 'booked')
SELECT r.appointment_id AS reply_id, max(s.starts_us) AS sent_us FROM r LEFT JOIN s ON s.patient_id = r.patient_id AND s.starts_us <= r.starts_us GROUP BY 1"""))
def latest_before(spark, sf_dir):
    """The latest message sent to a patient before each reply (as-of): one sort of both kinds together."""
    from pyspark.sql import Window

    w = Window.partitionBy("patient_id").orderBy("starts_us", F.desc("sent")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = appointments(spark, sf_dir).where("status IN ('arrived', 'booked')").withColumn("sent", (F.col("status") == "booked").cast("int"))
    marked = rows.withColumn("sent_us", F.last(F.when(F.col("sent") == 1, F.col("starts_us")), ignorenulls=True).over(w))
    return marked.where("sent = 0").select(F.col("appointment_id").alias("reply_id"), "sent_us")
