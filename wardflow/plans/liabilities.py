"""Deferred income of courses, gift-card roll-forward, product sales and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import AS_OF, invoice_lines, sql, table

FROM, TO = "2001-01-01", "2001-06-30"


# a course is an invoice line: quantity sessions, of which line_no * 5 are used, valid for 365 days from its day
def courses_of(lines: DataFrame) -> DataFrame:
    used = F.least(F.col("quantity"), F.col("line_no").cast("long") * 5)
    return lines.select(F.col("product_id"), "day", F.date_add("day", 364).alias("expires_on"), F.col("quantity").alias("sessions"), used.alias("used"), "net_pence")


def course_liability_of(courses: DataFrame, as_at: str) -> DataFrame:
    """Unused value of open courses (rounded for each course), and what of it expires within 30 days. The expiry day is valid."""
    day = F.lit(as_at).cast("date")
    top, bottom = F.col("net_pence") * (F.col("sessions") - F.col("used")) * 2 + F.col("sessions"), F.col("sessions") * 2
    value = ((top - top % bottom) / bottom).cast("long")
    valid = courses.where((F.col("day") <= day) & (F.col("expires_on") >= day) & (F.col("used") < F.col("sessions"))).withColumn("value", value)
    soon = F.datediff("expires_on", day) <= 30
    return valid.groupBy(F.date_format("expires_on", "yyyy-MM").alias("expires_month")).agg(F.count("*").alias("courses"), F.sum(F.col("sessions") - F.col("used")).alias("sessions_left"), F.sum("value").alias("liability_pence"), F.sum(F.when(soon, F.col("value")).otherwise(0)).alias("expiring_pence"))


@query(sql("lines", f""", c AS (SELECT day + 364 AS expires_on, day, quantity AS sessions, least(quantity, line_no * 5) AS used, net_pence FROM lines),
v AS (SELECT *, (net_pence * (sessions - used) * 2 + sessions) // (sessions * 2) AS value FROM c WHERE day <= DATE '{AS_OF}' AND expires_on >= DATE '{AS_OF}' AND used < sessions)
SELECT strftime(expires_on, '%Y-%m') AS expires_month, count(*) AS courses, CAST(sum(sessions - used) AS BIGINT) AS sessions_left, CAST(sum(value) AS BIGINT) AS liability_pence,
CAST(sum(CASE WHEN date_diff('day', DATE '{AS_OF}', expires_on) <= 30 THEN value ELSE 0 END) AS BIGINT) AS expiring_pence FROM v GROUP BY 1"""))
def course_liability(spark, sf_dir):
    return course_liability_of(courses_of(invoice_lines(spark, sf_dir)), AS_OF)


def roll_forward(moves: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Opening balance, what was sold, spent and credited in the period, and the closing balance, from signed moves
    (day, kind, amount_pence). 'expire' moves count apart."""
    before, inside = F.col("day") < F.lit(first).cast("date"), F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    real = F.col("kind") != "expire"
    total = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("amount_pence"))), F.lit(0)).alias(name)
    kinds = [total(inside & (F.col("kind") == k), f"{k}_pence") for k in ("sold", "spent", "credited", "expire")]
    return moves.groupBy(*by).agg(total(before & real, "opening_pence"), *kinds, total((before | inside) & real, "closing_pence"))


# a gift card is a part: lines sell (O), spend (F) or credit (R) on it
_KIND = {"N": "sold", "A": "spent", "R": "credited"}


@query(f"""WITH m AS (SELECT l_partkey % 50 AS card_group, CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'N' THEN 'sold' WHEN 'A' THEN 'spent' ELSE 'credited' END AS kind,
CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END * CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS a FROM lineitem)
SELECT card_group, CAST(coalesce(sum(a) FILTER (day < DATE '{FROM}'), 0) AS BIGINT) AS opening_pence,
{", ".join(f"CAST(coalesce(sum(a) FILTER (kind = '{k}' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}'), 0) AS BIGINT) AS {k}_pence" for k in ("sold", "spent", "credited", "expire"))},
CAST(coalesce(sum(a) FILTER (day <= DATE '{TO}'), 0) AS BIGINT) AS closing_pence FROM m GROUP BY 1""")
def gift_card_rollforward(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "sold").when(F.col("l_returnflag") == "A", "spent").otherwise("credited")
    amount = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long") * F.when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    moves = line.select((F.col("l_partkey") % 50).alias("card_group"), F.to_date("l_shipdate").alias("day"), kind.alias("kind"), amount.alias("amount_pence"))
    return roll_forward(moves, FROM, TO, "card_group")


@query(sql("lines", f"""SELECT product_id, CAST(sum(CASE WHEN credited THEN -quantity ELSE quantity END) AS BIGINT) AS quantity, CAST(sum(CASE WHEN credited THEN -net_pence ELSE net_pence END) AS BIGINT) AS net_pence,
CAST(sum(CASE WHEN credited THEN -vat_pence ELSE vat_pence END) AS BIGINT) AS vat_pence FROM lines WHERE day BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY 1"""))
def product_sales(spark, sf_dir):
    """Sold less credited, by product."""
    signed = lambda c: F.sum(F.when(F.col("credited"), -F.col(c)).otherwise(F.col(c))).alias(c)
    return invoice_lines(spark, sf_dir).where(F.col("day").between(F.lit(FROM).cast("date"), F.lit(TO).cast("date"))).groupBy("product_id").agg(signed("quantity"), signed("net_pence"), signed("vat_pence"))


@query("""WITH s AS (SELECT l_partkey AS product_id, CAST(sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS on_hand FROM lineitem GROUP BY 1)
SELECT p_partkey AS product_id, coalesce(on_hand, 0) AS on_hand, greatest(coalesce(on_hand, 0), 0) * CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS value_pence, coalesce(on_hand, 0) <= 10 AS low FROM part LEFT JOIN s ON p_partkey = product_id""")
def stock_on_hand(spark, sf_dir):
    """Stock as the sum of moves, its value (never below zero) and the low flag, for every product."""
    moves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).cast("long").alias("on_hand"))
    held = F.coalesce("on_hand", F.lit(0).cast("long"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("price_pence"))
    return parts.join(moves, "product_id", "left").select("product_id", held.alias("on_hand"), (F.greatest(held, F.lit(0)) * F.col("price_pence")).alias("value_pence"), (held <= 10).alias("low"))
