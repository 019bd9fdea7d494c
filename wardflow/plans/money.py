"""Revenue, debt, authorisation, caseload and VAT reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import AS_OF, invoice_lines, invoices, sql

BANDS = ((0, "not_due"), (30, "d1_30"), (60, "d31_60"), (90, "d61_90"))
LAST_BAND = "d91_up"


def debt_band(days: Column) -> Column:
    """Band of days past due; the due day itself is not yet due."""
    out = F.lit(LAST_BAND)
    for most, name in reversed(BANDS):
        out = F.when(days <= most, F.lit(name)).otherwise(out)
    return out


def aged_debt_of(debts: DataFrame, as_of: str) -> DataFrame:
    """Open balances by payer type and band, the oldest due day, and a row of totals (payer_type 'total')."""
    day = F.lit(as_of).cast("date")
    open_ = debts.where("balance_pence > 0").withColumn("band", debt_band(F.datediff(day, F.coalesce("due_on", "issued_on"))))
    sums = [F.sum(F.when(F.col("band") == b, F.col("balance_pence")).otherwise(0)).alias(b) for b in [*(n for _, n in BANDS), LAST_BAND]]
    rolled = open_.rollup("payer_type").agg(F.grouping_id().alias("level"), F.count("*").alias("invoices"), F.sum("balance_pence").alias("owed_pence"), *sums, F.min("due_on").alias("oldest_due"))
    return rolled.withColumn("payer_type", F.when(F.col("level") == 1, F.lit("total")).otherwise(F.coalesce("payer_type", F.lit("unknown")))).drop("level")


_DAYS = f"date_diff('day', coalesce(due_on, issued_on), DATE '{AS_OF}')"
_BANDS = f"""CAST(sum(CASE WHEN d <= 0 THEN b ELSE 0 END) AS BIGINT) AS not_due, CAST(sum(CASE WHEN d BETWEEN 1 AND 30 THEN b ELSE 0 END) AS BIGINT) AS d1_30, CAST(sum(CASE WHEN d BETWEEN 31 AND 60 THEN b ELSE 0 END) AS BIGINT) AS d31_60,
CAST(sum(CASE WHEN d BETWEEN 61 AND 90 THEN b ELSE 0 END) AS BIGINT) AS d61_90, CAST(sum(CASE WHEN d > 90 THEN b ELSE 0 END) AS BIGINT) AS d91_up, min(due_on) AS oldest_due"""


@query(sql("invoices", f""", o AS (SELECT coalesce(payer_type, 'unknown') AS payer_type, due_on, balance_pence AS b, {_DAYS} AS d FROM invoices WHERE balance_pence > 0)
SELECT payer_type, count(*) AS invoices, CAST(sum(b) AS BIGINT) AS owed_pence, {_BANDS} FROM o GROUP BY payer_type
UNION ALL SELECT 'total' AS payer_type, count(*) AS invoices, CAST(sum(b) AS BIGINT) AS owed_pence, {_BANDS} FROM o"""))
def aged_debt(spark, sf_dir):
    return aged_debt_of(invoices(spark, sf_dir), AS_OF)


@query(sql("invoices", f"SELECT site_id, count(*) AS invoices, CAST(sum(balance_pence) AS BIGINT) AS overdue_pence FROM invoices WHERE balance_pence > 0 AND due_on < DATE '{AS_OF}' GROUP BY site_id"))
def overdue(spark, sf_dir):
    due = invoices(spark, sf_dir).where((F.col("balance_pence") > 0) & (F.col("due_on") < F.lit(AS_OF).cast("date")))
    return due.groupBy("site_id").agg(F.count("*").alias("invoices"), F.sum("balance_pence").alias("overdue_pence"))


def revenue_facts_of(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoiced, credited and received sums as kind-tagged rows by month, site and payer type."""
    keys = ("month", "site_id", "payer_type")
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    total = lambda df, kind, amount: df.groupBy(*keys).agg(F.count("*").alias("count"), F.sum(amount).alias("amount_pence")).withColumn("kind", F.lit(kind))
    billed = total(bills.select(month("issued_on"), "site_id", "payer_type", "total_pence"), "invoiced", "total_pence")
    paid = total(bills.where("paid_pence > 0").select(month("due_on"), "site_id", "payer_type", "paid_pence"), "received", "paid_pence")
    back = total(lines.where("credited").join(bills.select("invoice_id", "site_id", "payer_type"), "invoice_id").select(month("day"), "site_id", "payer_type", "net_pence"), "credited", "net_pence")
    return billed.unionByName(back).unionByName(paid)


_REVENUE = """, facts AS (
SELECT strftime(issued_on, '%Y-%m') AS month, site_id, payer_type, count(*) AS count, CAST(sum(total_pence) AS BIGINT) AS amount_pence, 'invoiced' AS kind FROM invoices GROUP BY 1, 2, 3
UNION ALL SELECT strftime(due_on, '%Y-%m') AS month, site_id, payer_type, count(*) AS count, CAST(sum(paid_pence) AS BIGINT) AS amount_pence, 'received' AS kind FROM invoices WHERE paid_pence > 0 GROUP BY 1, 2, 3
UNION ALL SELECT strftime(day, '%Y-%m') AS month, site_id, payer_type, count(*) AS count, CAST(sum(net_pence) AS BIGINT) AS amount_pence, 'credited' AS kind FROM lines JOIN invoices USING (invoice_id) WHERE credited GROUP BY 1, 2, 3)
"""


@query(sql("invoices lines", _REVENUE + "SELECT * FROM facts"))
def revenue_facts(spark, sf_dir):
    return revenue_facts_of(invoices(spark, sf_dir), invoice_lines(spark, sf_dir))


def revenue(facts: DataFrame, by: str) -> DataFrame:
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount_pence"))), F.lit(0)).alias(f"{k}_pence")
    return facts.groupBy(by).agg(part("invoiced"), part("credited"), part("received")).withColumn("net_pence", F.col("invoiced_pence") - F.col("credited_pence"))


def _revenue_sql(by: str) -> str:
    part = ", ".join(f"CAST(coalesce(sum(amount_pence) FILTER (kind = '{k}'), 0) AS BIGINT) AS {k}_pence" for k in ("invoiced", "credited", "received"))
    return sql("invoices lines", _REVENUE + f"SELECT *, invoiced_pence - credited_pence AS net_pence FROM (SELECT {by}, {part} FROM facts GROUP BY {by})")


@query(_revenue_sql("month"))
def revenue_by_month(spark, sf_dir):
    return revenue(revenue_facts(spark, sf_dir), "month")


@query(_revenue_sql("payer_type"))
def revenue_by_payer(spark, sf_dir):
    return revenue(revenue_facts(spark, sf_dir), "payer_type")


@query(sql("lines", "SELECT tax_pc, count(*) AS lines, CAST(sum(net_pence) AS BIGINT) AS net_pence, CAST(sum(vat_pence) AS BIGINT) AS vat_pence FROM lines GROUP BY 1"))
def vat_summary(spark, sf_dir):
    """Rounded for each line, then summed by rate."""
    return invoice_lines(spark, sf_dir).groupBy("tax_pc").agg(F.count("*").alias("lines"), F.sum("net_pence").alias("net_pence"), F.sum("vat_pence").alias("vat_pence"))


# authorisations: an order stands for a limit of sessions, its lines for sessions used
_STATE = "CASE WHEN used >= allowed THEN 'exhausted' WHEN expires_on < DATE '2001-08-01' THEN 'expired' WHEN used = 0 THEN 'not_started' ELSE 'active' END"
_AUTH = f""", auths AS (SELECT *, allowed - used AS sessions_left, {_STATE} AS state FROM (
SELECT invoice_id, issued_on, issued_on + 180 AS expires_on, 2 + invoice_id % 6 AS allowed, coalesce(used, 0) AS used FROM invoices LEFT JOIN (SELECT invoice_id, count(*) AS used FROM lines GROUP BY 1) USING (invoice_id)))
"""


def authorisations_of(bills: DataFrame, lines: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Sessions allowed and used, the state, and the reasons for an alert."""
    used = lines.groupBy("invoice_id").agg(F.count("*").alias("used"))
    rows = bills.select("invoice_id", "issued_on", F.date_add("issued_on", 180).alias("expires_on"), (2 + F.col("invoice_id") % 6).alias("allowed")).join(used, "invoice_id", "left").fillna(0, ["used"])
    day = F.lit(as_of).cast("date")
    state = F.when(F.col("used") >= F.col("allowed"), "exhausted").when(F.col("expires_on") < day, "expired").when(F.col("used") == 0, "not_started").otherwise("active")
    low = (F.col("allowed") - F.col("used")) * 100 <= F.col("allowed") * 15
    reasons = F.array_compact(F.array(F.when(low, F.lit("few_sessions")), F.when(F.datediff("expires_on", day).between(0, 30), F.lit("expires_soon")), F.when(F.col("used") > F.col("allowed"), F.lit("over_limit"))))
    return rows.withColumns({"sessions_left": F.col("allowed") - F.col("used"), "state": state, "reasons": reasons})


@query(sql("invoices lines", _AUTH + "SELECT state, sessions_left, count(*) AS authorisations FROM auths GROUP BY ALL"))
def authorisation_histogram(spark, sf_dir):
    return authorisations_of(invoices(spark, sf_dir), invoice_lines(spark, sf_dir)).groupBy("state", "sessions_left").agg(F.count("*").alias("authorisations"))


@query(sql("invoices lines", _AUTH + f""", r AS (SELECT 'few_sessions' AS reason FROM auths WHERE sessions_left * 100 <= allowed * 15
UNION ALL SELECT 'expires_soon' FROM auths WHERE date_diff('day', DATE '{AS_OF}', expires_on) BETWEEN 0 AND 30 UNION ALL SELECT 'over_limit' FROM auths WHERE used > allowed)
SELECT reason, count(*) AS authorisations FROM r GROUP BY 1"""))
def authorisation_alerts(spark, sf_dir):
    return authorisations_of(invoices(spark, sf_dir), invoice_lines(spark, sf_dir)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("authorisations"))


# caseload: an order opens a case at a site on its day; a finished one closes 30 days later
@query(sql("invoices", """, o AS (SELECT site_id, count(*) AS n FROM invoices WHERE issued_on BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY 1),
c AS (SELECT site_id, count(*) AS n FROM invoices WHERE balance_pence = 0 AND due_on BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY 1),
k AS (SELECT site_id, count(*) AS n FROM invoices WHERE balance_pence > 0 AND issued_on <= DATE '2001-06-30' GROUP BY 1)
SELECT coalesce(o.site_id, c.site_id, k.site_id) AS site_id, coalesce(o.n, 0) AS opened, coalesce(c.n, 0) AS closed, coalesce(k.n, 0) AS open_now
FROM o FULL JOIN c ON o.site_id IS NOT DISTINCT FROM c.site_id FULL JOIN k ON k.site_id IS NOT DISTINCT FROM coalesce(o.site_id, c.site_id)"""))
def caseload(spark, sf_dir):
    """Opened, closed and open cases by site, in one grouped scan."""
    inside = lambda c: F.col(c).between(F.lit("2001-01-01").cast("date"), F.lit("2001-06-30").cast("date"))
    opened, closed, now = inside("issued_on"), (F.col("balance_pence") == 0) & inside("due_on"), (F.col("balance_pence") > 0) & (F.col("issued_on") <= F.lit("2001-06-30").cast("date"))
    out = invoices(spark, sf_dir).where(opened | closed | now).groupBy("site_id")
    return out.agg(F.count_if(opened).alias("opened"), F.count_if(closed).alias("closed"), F.count_if(now).alias("open_now"))
