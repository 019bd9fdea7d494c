"""The clinic's tables as views of the supplied ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the supplied codes stand for, and the days on which reports look back.
OUTCOMES = {"view": "attended", "purchase": "arrived", "error": "dna", "click": "late_cancelled", "signup": "booked"}
PAYERS = {"AUTOMOBILE": "insurer", "BUILDING": "mlc", "FURNITURE": "solicitor", "HOUSEHOLD": "employer", "MACHINERY": "self_pay"}
NOW = "2024-01-25 00:00:00"
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(value: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(names.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def pence(value: Column) -> Column:
    """Whole pence, halves away from zero."""
    return F.round(value * 100).cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One booking a row: ids, day, starts_us and ends_us (microseconds), minutes, status, outcome at NOW."""
    e = table(spark, sf_dir, "events")
    status = coded(F.col("event_type"), OUTCOMES)
    outcome = F.when(status == "booked", F.when(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz"), F.lit("upcoming")).otherwise(F.lit("unrecorded"))).when(status == "arrived", F.lit("attended")).otherwise(status)
    minutes = (15 * (1 + F.col("event_id") % 4)).cast("long")
    return e.select(
        F.col("event_id").alias("appointment_id"),
        F.col("user_id").alias("patient_id"),
        (F.col("user_id") % 5).alias("site_id"),
        (F.col("user_id") % 10).alias("practitioner_id"),
        F.to_date("ts").alias("day"),
        micros(F.col("ts")).alias("starts_us"),
        (micros(F.col("ts")) + minutes * 60_000_000).alias("ends_us"),
        minutes.alias("minutes"),
        status.alias("status"),
        outcome.alias("outcome"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice a row, with its payer and site, in whole pence."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    total = pence(F.col("o_totalprice"))
    paid = F.when(F.col("o_orderstatus") == "F", total).when(F.col("o_orderstatus") == "P", (total / 2).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = o.select("o_custkey", F.col("o_orderkey").alias("invoice_id"), F.to_date("o_orderdate").alias("issued_on"), F.date_add(F.to_date("o_orderdate"), 30).alias("due_on"), total.alias("total_pence"), paid.alias("paid_pence"))
    who = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("patient_id"), coded(F.col("c_mktsegment"), PAYERS).alias("payer_type"), F.col("n_regionkey").alias("site_id"))
    return rows.join(who, F.col("o_custkey") == F.col("patient_id"), "left").select("invoice_id", F.col("o_custkey").alias("patient_id"), "payer_type", "site_id", "issued_on", "due_on", "total_pence", "paid_pence", (F.col("total_pence") - F.col("paid_pence")).alias("balance_pence"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice line a row: product, quantity, net and VAT pence, the day and whether it was credited."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("gross_pence"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("discount_pc"),
        F.floor(F.col("l_tax") * 100 + 0.5).cast("long").alias("tax_pc"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_returnflag") == "R").alias("credited"),
    ).withColumn("net_pence", rounded(F.col("gross_pence") * (100 - F.col("discount_pc")), 100)).withColumn("vat_pence", rounded(F.col("net_pence") * F.col("tax_pc"), 100))


def rounded(top: Column, bottom: int) -> Column:
    """top / bottom in whole numbers, halves away from zero."""
    up = F.abs(top) + bottom // 2
    return (F.signum(top) * ((up - up % bottom) / bottom)).cast("long")


def _case(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


SQL = {
    "appts": f"""appts AS (
  SELECT *, CASE WHEN status = 'booked' THEN CASE WHEN starts_us >= epoch_us(TIMESTAMP '{NOW}') THEN 'upcoming' ELSE 'unrecorded' END WHEN status = 'arrived' THEN 'attended' ELSE status END AS outcome
  FROM (SELECT event_id AS appointment_id, user_id AS patient_id, user_id % 5 AS site_id, user_id % 10 AS practitioner_id, CAST(ts AS DATE) AS day,
        epoch_us(ts) AS starts_us, epoch_us(ts) + 900000000 * (1 + event_id % 4) AS ends_us, 15 * (1 + event_id % 4) AS minutes, {_case("event_type", OUTCOMES)} AS status FROM events))""",
    "invoices": f"""invoices AS (
  SELECT *, total_pence - paid_pence AS balance_pence FROM (
  SELECT o_orderkey AS invoice_id, o_custkey AS patient_id, {_case("c_mktsegment", PAYERS)} AS payer_type, n_regionkey AS site_id, CAST(o_orderdate AS DATE) AS issued_on, CAST(o_orderdate AS DATE) + 30 AS due_on,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_pence,
         CASE o_orderstatus WHEN 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) WHEN 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) // 2 ELSE 0 END AS paid_pence
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey))""",
    "lines": """lines AS (
  SELECT *, (net_pence * tax_pc + 50) // 100 AS vat_pence FROM (SELECT *, (gross_pence * (100 - discount_pc) + 50) // 100 AS net_pence FROM (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS gross_pence,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS discount_pc, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax_pc, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'R' AS credited FROM lineitem)))""",
}


def sql(names: str, body: str) -> str:
    """A query over the views of those names."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
