"""Dates, rounding, distances, message parts and scores as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import appointments, invoice_lines, sql, table

ZONE = "Europe/London"
#: The GSM-7 alphabet, and its characters that count twice; the earth's radius in miles.
GSM = "@£$¥èéùìòÇ\nØø\rÅåΔ_ΦΓΛΩΠΨΣΘΞÆæßÉ !\"#¤%&'()*+,-./0123456789:;<=>?¡ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÑÜ§¿abcdefghijklmnopqrstuvwxyzäöñüà"
GSM_TWICE = "^{}\\[~]|€"
EARTH_MILES = 3958.8


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once for a row however often `then` uses it; else each use repeats the whole expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def local_day(instant: Column) -> Column:
    """The UK date of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def local_minute(instant: Column) -> Column:
    local = F.from_utc_timestamp(instant, ZONE)
    return F.hour(local) * 60 + F.minute(local)


def from_local(wall: Column) -> Column:
    """The instant of a UK wall clock; null in the hour that spring skips, the first one in the hour that autumn repeats."""
    instant = F.to_utc_timestamp(wall, ZONE)
    return F.when(F.from_utc_timestamp(instant, ZONE) == wall, instant)


def whole_years(born: Column, on: Column) -> Column:
    """Age in whole years; who is born on 29 February has a birthday on 1 March of other years."""
    early = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - early.cast("int")


def add_years(day: Column, n: int) -> Column:
    return F.add_months(day, 12 * n)


def half_away(value: Column) -> Column:
    return F.round(value).cast("long")


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sms_segments(text: Column) -> Column:
    """Parts a message is sent in: 160 or 153 GSM-7 units, else 70 or 67 UTF-16 units."""
    quoted = lambda s: "".join(f"\\{c}" if c in "\\]^-[" else c for c in s)
    gsm = text.rlike(rf"^[{quoted(GSM + GSM_TWICE)}]*$")
    units = F.when(gsm, F.length(text) + F.length(F.regexp_replace(text, rf"[^{quoted(GSM_TWICE)}]", ""))).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))
    one, many = F.when(gsm, 160).otherwise(70), F.when(gsm, 153).otherwise(67)
    return F.when(units <= one, 1).otherwise(F.ceil(units / many)).cast("long")


def format_pence(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("£"), F.format_number(F.abs(value) / 100, 2))


def score(answers: Column, needed: int, top: int) -> Column:
    """Percent of an outcome measure: mean of what was answered (array, nulls are missing); null under `needed` answers."""
    given = F.filter(answers, lambda x: x.isNotNull())
    total = F.aggregate(given, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(given) >= needed, F.floor((total * 200 + F.size(given) * top) / (F.size(given) * top * 2)).cast("long"))


@query("""SELECT s_suppkey, CAST(round(2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(51.5 - a) / 2), 2) + cos(radians(a)) * cos(radians(51.5)) * pow(sin(radians(-0.1 - b) / 2), 2))))) AS BIGINT) AS miles
FROM (SELECT s_suppkey, CAST(50 + s_suppkey % 9 AS DOUBLE) AS a, CAST(s_nationkey % 7 - 5 AS DOUBLE) AS b FROM supplier)""")
def haversine(spark, sf_dir):
    a, b = (50 + F.col("s_suppkey") % 9).cast("double"), (F.col("s_nationkey") % 7 - 5).cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", half_away(miles(a, b, F.lit(51.5), F.lit(-0.1))).alias("miles"))


@query("""SELECT p_partkey, CASE WHEN u <= 160 THEN 1 ELSE CAST(ceil(u / 153) AS BIGINT) END AS segments FROM (SELECT p_partkey, length(repeat(p_name || ' ', 1 + p_size)) AS u FROM part)""")
def sms_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sms_segments(F.expr("repeat(p_name || ' ', 1 + p_size)")).alias("segments"))


@query(sql("lines", "SELECT invoice_id, line_no, net_pence, vat_pence, net_pence + vat_pence AS gross_pence, (net_pence + 1) // 2 AS half_credit FROM lines"))
def vat_lines(spark, sf_dir):
    """Net, VAT and gross of each line, and the share of a half credit, in whole pence."""
    half = F.floor((F.col("net_pence") + 1) / 2).cast("long")
    return invoice_lines(spark, sf_dir).select("invoice_id", "line_no", "net_pence", "vat_pence", (F.col("net_pence") + F.col("vat_pence")).alias("gross_pence"), half.alias("half_credit"))


@query("""SELECT o_orderkey, CASE WHEN n >= 2 THEN CAST(floor((t * 200 + n * 7) / (n * 14)) AS BIGINT) END AS percent
FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_linenumber <> 3) AS n, CAST(sum(CASE WHEN l_linenumber <> 3 THEN l_linenumber ELSE 0 END) AS BIGINT) AS t FROM lineitem GROUP BY 1)""")
def outcome_scores(spark, sf_dir):
    """Answers are line numbers up to 7; the third is missing."""
    answers = F.collect_list(F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("v")))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(answers.alias("a"))
    return a.select("o_orderkey", score(F.transform("a", lambda x: x["v"].cast("long")), 2, 7).alias("percent"))


@query(sql("appts", "SELECT day, CAST(isodow(day) AS INTEGER) AS weekday, CAST(date_trunc('week', day) AS DATE) AS week, strftime(day, '%Y-%m') AS month, CAST(date_trunc('quarter', day) AS DATE) AS quarter, count(*) AS n FROM appts GROUP BY ALL"))
def calendar_keys(spark, sf_dir):
    """Weekday (Monday 1), Monday, month and quarter of each day."""
    a = appointments(spark, sf_dir)
    return a.groupBy("day", (F.weekday("day") + 1).alias("weekday"), F.trunc("day", "week").alias("week"), F.date_format("day", "yyyy-MM").alias("month"), F.trunc("day", "quarter").alias("quarter")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 1 ELSE 0 END AS DATE) AS uk_day FROM orders WHERE month(o_orderdate) NOT IN (3, 10)""")
def london_dates(spark, sf_dir):
    """The UK date of 23:30 UTC: the next day in summer."""
    late = F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 23:30:00")))
    return table(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(3, 10)).select("o_orderkey", local_day(late).alias("uk_day"))


@query("""SELECT o_orderkey, date_diff('year', b, d) - CASE WHEN month(d) * 100 + day(d) < month(b) * 100 + day(b) THEN 1 ELSE 0 END AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1960-02-29' + CAST(o_custkey % 9000 AS INTEGER) AS b FROM orders)""")
def ages(spark, sf_dir):
    born = F.date_add(F.lit("1960-02-29").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", whole_years(born, F.to_date("o_orderdate")).cast("long").alias("age"))
