"""Patient records: outcome measures, episodes and their checks, caseload, line amounts, fact contracts, anonymising and what
is held on a person, rows that must not change, tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.plans.attendance import ratio
from wardflow.registry import query
from wardflow.sources.tables import NOW, appointments, invoice_lines, invoices, sql, table

# ---- outcome measures ----


@dataclass(frozen=True)
class Measure:
    """A questionnaire: number of items, lowest and highest answer, how many may be missing."""

    items: int
    least: int
    most: int
    missing: int


#: The questionnaires, and upper bounds (in tenths, inclusive) of their bands.
MEASURES = {"ndi": Measure(10, 0, 5, 2), "odi": Measure(10, 0, 5, 2), "nprs": Measure(1, 0, 10, 0), "psfs": Measure(5, 0, 10, 2), "quickdash": Measure(11, 1, 5, 1)}
BANDS = {
    "ndi": [(99, "No disability"), (299, "Mild"), (499, "Moderate"), (699, "Severe"), (1000, "Complete")],
    "odi": [(200, "Minimal"), (400, "Moderate"), (600, "Severe"), (800, "Very severe"), (1000, "Bed-bound, or symptoms overstated")],
    "nprs": [(0, "No pain"), (30, "Mild"), (60, "Moderate"), (100, "Severe")],
}
HIGHER_IS_BETTER = ("psfs",)


def _half_up(top: Column, bottom: Column) -> Column:
    return F.floor((2 * top + bottom) / (2 * bottom)).cast("long")


def outcome_score(measure: str, raw: Column, names: Column | None = None) -> Column:
    """Struct (tenths, answered, band, error) of one measure's answers.

    raw: array of what was entered, '' for unanswered. names (PSFS): the activity of each item. error is null or one of
    unknown_item, range, rate, name, few, missing; the first that applies.
    """
    m = MEASURES[measure]
    given = F.filter(raw, lambda x: x != "")
    value = lambda x: F.when(x.rlike(r"^-?\d{1,9}$"), x.try_cast("int"))
    values = F.transform(given, value)
    n, total = F.size(given), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    wrong = F.exists(values, lambda x: ~F.coalesce(x.between(m.least, m.most), F.lit(False)))
    error = F.when(F.size(raw) > m.items, "unknown_item").when(wrong, "range")
    if measure == "psfs":
        pairs = F.arrays_zip(raw.alias("r"), names.alias("n"))
        error = error.when(F.exists(pairs, lambda p: (F.trim(p["n"]) != "") & (p["r"] == "")), "rate").when(F.exists(pairs, lambda p: (F.trim(p["n"]) == "") & (p["r"] != "")), "name").when(n < 3, "few")
        tenths = _half_up(total * 10, n)
    else:
        error = error.when(m.items - n > m.missing, "missing")
        tenths = {"nprs": total * 10, "quickdash": _half_up((total - n) * 250, n)}.get(measure, _half_up(total * 1000, n * m.most))
    band = F.lit(None).cast("string")
    for top, name in reversed(BANDS.get(measure, [])):
        band = F.when(tenths <= top, name).otherwise(band)
    fine = error.isNull()
    return F.struct(F.when(fine, tenths).alias("tenths"), F.when(fine, n.cast("long")).alias("answered"), F.when(fine, band).alias("band"), error.alias("error"))


def change(measure: Column, first: Column, last: Column) -> Column:
    """better, worse or same, in the measure's own direction."""
    up = measure.isin(*HIGHER_IS_BETTER)
    return F.when(first == last, "same").when((last > first) == up, "better").otherwise("worse")


_NAMES = list(MEASURES)
_ANSWER = "CASE (k * 5 + i * 11) % 23 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END WHEN 2 THEN CASE WHEN k % 6 = 0 THEN '11' ELSE '1' END ELSE CAST((k + i * i + k * i) % 5 + 1 AS {text}) END"
_ITEMS = {n: m.items for n, m in MEASURES.items()}


def _score_sql(name: str) -> str:
    m = MEASURES[name]
    bands = "CASE " + " ".join(f"WHEN tenths <= {top} THEN '{label}'" for top, label in BANDS.get(name, [])) + " END" if name in BANDS else "NULL"
    up = lambda a, b: f"CAST(floor((2 * ({a}) + {b}) / (2 * ({b}))) AS BIGINT)"
    tenths = {"nprs": "total * 10", "quickdash": up("(total - n) * 250", "n"), "psfs": up("total * 10", "n")}.get(name, up("total * 1000", f"(n * {m.most})"))
    rest = "WHEN unrated THEN 'rate' WHEN unnamed THEN 'name' WHEN n < 3 THEN 'few'" if name == "psfs" else f"WHEN {m.items} - n > {m.missing} THEN 'missing'"
    return f"""SELECT s_suppkey, '{name}' AS measure, CASE WHEN error IS NULL THEN tenths END AS tenths, CASE WHEN error IS NULL THEN n END AS answered, CASE WHEN error IS NULL THEN {bands} END AS band, error FROM (SELECT *, CASE WHEN error IS NULL THEN {tenths} END AS tenths FROM (
SELECT *, CASE WHEN wrong THEN 'range' {rest} END AS error FROM (SELECT k AS s_suppkey, count(*) FILTER (a <> '') AS n, CAST(coalesce(sum(try_cast(a AS INTEGER)) FILTER (a <> ''), 0) AS BIGINT) AS total, coalesce(bool_or(NOT coalesce(try_cast(a AS INTEGER) BETWEEN {m.least} AND {m.most}, false)) FILTER (a <> ''), false) AS wrong,
bool_or(named AND a = '') AS unrated, bool_or(NOT named AND a <> '') AS unnamed FROM (SELECT k, i, {_ANSWER.format(text='VARCHAR')} AS a, NOT (k % 3 = 0 AND i > 3 OR (k + i) % 29 = 0) AS named FROM (SELECT s_suppkey AS k, unnest(generate_series(1, {m.items})) AS i FROM supplier)) GROUP BY k)))"""


@query(" UNION ALL ".join(_score_sql(n) for n in MEASURES))
def outcome_measures(spark, sf_dir):
    """Scores of five questionnaires from made-up answers, some of them missing or out of range."""
    out = None
    for name, m in MEASURES.items():
        number = F.sequence(F.lit(1), F.lit(m.items))
        s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(number).alias("i"))
        s = s.select("k", "i", F.expr(_ANSWER.format(text="STRING")).alias("a"), F.expr("CASE WHEN k % 3 = 0 AND i > 3 OR (k + i) % 29 = 0 THEN ' ' ELSE 'walk' END").alias("name"))
        s = s.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "a", "name"))).alias("x"))
        scored = s.select(F.col("k").alias("s_suppkey"), F.lit(name).alias("measure"), outcome_score(name, F.col("x.a"), F.col("x.name")).alias("s")).select("s_suppkey", "measure", "s.*")
        out = scored if out is None else out.unionByName(scored)
    return out


@query("SELECT s_suppkey, measure, CASE WHEN a = b THEN 'same' WHEN (b > a) = (measure = 'psfs') THEN 'better' ELSE 'worse' END AS direction FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'psfs' ELSE 'ndi' END AS measure, s_suppkey % 7 AS a, s_suppkey % 5 AS b FROM supplier)")
def outcome_changes(spark, sf_dir):
    """Whether later scores are better, by the direction of the measure."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, F.when(k % 2 == 0, "psfs").otherwise("ndi").alias("measure")).withColumn("direction", change(F.col("measure"), k % 7, k % 5))


# ---- episodes ----


@query(sql("appts", """, v AS (SELECT *, lag(day) OVER (PARTITION BY patient_id ORDER BY starts_us, appointment_id) AS before FROM appts WHERE outcome = 'attended'),
a AS (SELECT patient_id, count(*) AS visits, min(day) AS first_visit, max(day) AS last_visit, date_diff('day', min(day), max(day)) AS span_days, max(date_diff('day', before, day)) AS longest_gap_days, count(DISTINCT site_id) AS sites, CAST(sum(minutes) AS BIGINT) AS minutes FROM v GROUP BY 1),
m AS (SELECT patient_id, count(*) FILTER (outcome = 'dna') AS missed, count(*) FILTER (outcome = 'late_cancelled') AS late_cancelled, count(*) FILTER (outcome = 'upcoming') AS upcoming, count(*) AS booked FROM appts GROUP BY 1)
SELECT m.*, coalesce(visits, 0) AS visits, first_visit, last_visit, span_days, longest_gap_days, coalesce(sites, 0) AS sites, coalesce(minutes, 0) AS minutes, CASE WHEN coalesce(visits, 0) + missed > 0 THEN coalesce(visits, 0) / (coalesce(visits, 0) + missed) END AS attended_share FROM m LEFT JOIN a USING (patient_id)"""))
def episode_summary(spark, sf_dir):
    """An episode's facts: visits, their span and longest gap, what was missed and cancelled, sites, minutes, attendance."""
    a = appointments(spark, sf_dir)
    w = Window.partitionBy("patient_id").orderBy("starts_us", "appointment_id")
    seen = a.where("outcome = 'attended'").withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    visits = seen.groupBy("patient_id").agg(F.count("*").alias("visits"), F.min("day").alias("first_visit"), F.max("day").alias("last_visit"), F.datediff(F.max("day"), F.min("day")).alias("span_days"), F.max("gap").alias("longest_gap_days"), F.countDistinct("site_id").alias("sites"), F.sum("minutes").alias("minutes"))
    count = lambda o: F.count_if(F.col("outcome") == o).alias({"dna": "missed"}.get(o, o))
    out = a.groupBy("patient_id").agg(count("dna"), count("late_cancelled"), count("upcoming"), F.count("*").alias("booked")).join(visits, "patient_id", "left").fillna(0, ["visits", "sites", "minutes"])
    return out.withColumn("attended_share", ratio(F.col("visits"), F.col("visits") + F.col("missed")))


#: Checks of an episode in order of severity: (code, severity, condition over its summary).
EPISODE_CHECKS = [
    ("NO_VISIT", "error", "visits = 0 AND booked > 0"),
    ("MISSED_MOST", "error", "missed > visits AND missed > 1"),
    ("LONG_GAP", "warning", "longest_gap_days > 10"),
    ("MANY_LATE_CANCELLED", "warning", "late_cancelled >= 3"),
    ("NOTHING_BOOKED", "warning", "upcoming = 0 AND visits > 0"),
    ("ONE_VISIT", "info", "visits = 1"),
    ("SEVERAL_SITES", "info", "sites > 1"),
    ("SHORT_SPAN", "info", "visits > 3 AND span_days < 7"),
]


@query(sql("appts", """, v AS (SELECT *, lag(day) OVER (PARTITION BY patient_id ORDER BY starts_us, appointment_id) AS before FROM appts WHERE outcome = 'attended'),
a AS (SELECT patient_id, count(*) AS visits, date_diff('day', min(day), max(day)) AS span_days, max(date_diff('day', before, day)) AS longest_gap_days, count(DISTINCT site_id) AS sites FROM v GROUP BY 1),
m AS (SELECT patient_id, count(*) FILTER (outcome = 'dna') AS missed, count(*) FILTER (outcome = 'late_cancelled') AS late_cancelled, count(*) FILTER (outcome = 'upcoming') AS upcoming, count(*) AS booked FROM appts GROUP BY 1),
e AS (SELECT m.*, coalesce(visits, 0) AS visits, span_days, longest_gap_days, coalesce(sites, 0) AS sites FROM m LEFT JOIN a USING (patient_id))
""" + " UNION ALL ".join(f"SELECT patient_id, {k} AS place, '{code}' AS code, '{severity}' AS severity FROM e WHERE {test}" for k, (code, severity, test) in enumerate(EPISODE_CHECKS))))
def episode_checks(spark, sf_dir):
    """Codes of what is odd in each episode, worst first."""
    found = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(k).alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for k, (code, severity, test) in enumerate(EPISODE_CHECKS)]))
    return episode_summary(spark, sf_dir).select("patient_id", F.explode(found).alias("c")).select("patient_id", "c.*")


# ---- caseload: an order is a case; its clerk number stands for the practitioner, a third of cases were referred ----

_CASES = ", cases AS (SELECT *, patient_id % 10 AS practitioner_id, CASE WHEN invoice_id % 3 = 0 THEN invoice_id % 40 END AS referrer_id, balance_pence > 0 AS is_open FROM invoices)\n"
_IN = "issued_on BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'"


def cases(spark, sf_dir) -> DataFrame:
    return invoices(spark, sf_dir).withColumns({"practitioner_id": F.col("patient_id") % 10, "referrer_id": F.when(F.col("invoice_id") % 3 == 0, F.col("invoice_id") % 40), "is_open": F.col("balance_pence") > 0})


@query(sql("invoices", _CASES + "SELECT site_id, practitioner_id, payer_type, count(*) AS cases FROM cases WHERE is_open GROUP BY ALL"))
def open_caseload(spark, sf_dir):
    """Open cases by site, practitioner and payer."""
    return cases(spark, sf_dir).where("is_open").groupBy("site_id", "practitioner_id", "payer_type").agg(F.count("*").alias("cases"))


@query(sql("invoices", _CASES + f"SELECT referrer_id, n_name AS name, cases FROM (SELECT referrer_id, count(*) AS cases FROM cases WHERE {_IN} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 100) LEFT JOIN nation ON n_nationkey = referrer_id"))
def referral_sources(spark, sf_dir):
    """The hundred largest sources of cases opened in a period, with names where they are known."""
    top = cases(spark, sf_dir).where(_IN.replace("DATE ", "DATE")).groupBy("referrer_id").agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), F.asc_nulls_last("referrer_id")).limit(100)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("referrer_id"), F.col("n_name").alias("name"))
    return top.join(names, "referrer_id", "left").select("referrer_id", "name", "cases")


@query(sql("invoices", _CASES + f""", f AS (SELECT patient_id, min(issued_on) AS first_on FROM cases GROUP BY 1), s AS (SELECT DISTINCT site_id, patient_id FROM cases WHERE {_IN})
SELECT site_id, count(*) AS patients, count(*) FILTER (first_on >= DATE '2001-01-01') AS new_patients, count(*) - count(*) FILTER (first_on >= DATE '2001-01-01') AS returning FROM s JOIN f USING (patient_id) GROUP BY 1"""))
def patient_mix_by_cases(spark, sf_dir):
    """Patients with a case opened in the period, and those whose first case it was (at any site)."""
    c = cases(spark, sf_dir)
    first = c.groupBy("patient_id").agg(F.min("issued_on").alias("first_on"))
    seen = c.where(_IN.replace("DATE ", "DATE")).select("site_id", "patient_id").distinct().join(first, "patient_id")
    new = F.count_if(F.col("first_on") >= F.lit("2001-01-01").cast("date"))
    return seen.groupBy("site_id").agg(F.count("*").alias("patients"), new.alias("new_patients"), (F.count("*") - new).alias("returning"))


# ---- amounts ----


def vat_in(gross: Column, rate_pc: Column) -> Column:
    """The VAT that an amount includes, in whole pence, halves up."""
    return F.floor((gross * rate_pc * 2 + (100 + rate_pc)) / (2 * (100 + rate_pc))).cast("long")


def part_of(amount: Column, part: Column, whole: Column) -> Column:
    """A proportional share in whole pence, halves up."""
    return F.floor((amount * part * 2 + whole) / (2 * whole)).cast("long")


@query(sql("lines", """SELECT invoice_id, line_no, net_pence, vat_pence, net_pence + vat_pence AS gross_pence, CAST(floor((gross_pence * tax_pc * 2 + 100 + tax_pc) / (2 * (100 + tax_pc))) AS BIGINT) AS vat_included,
quantity // 3 AS credited, CAST(floor((net_pence * (quantity // 3) * 2 + quantity) / (2 * quantity)) AS BIGINT) AS credit_net, CAST(floor((vat_pence * (quantity // 3) * 2 + quantity) / (2 * quantity)) AS BIGINT) AS credit_vat FROM lines"""))
def line_amounts(spark, sf_dir):
    """Net, VAT on top and VAT included of each line, and the share of a credit for a third of its quantity."""
    lines, back = invoice_lines(spark, sf_dir), F.floor(F.col("quantity") / 3)
    return lines.select(
        "invoice_id", "line_no", "net_pence", "vat_pence", (F.col("net_pence") + F.col("vat_pence")).alias("gross_pence"), vat_in(F.col("gross_pence"), F.col("tax_pc")).alias("vat_included"), back.alias("credited"),
        part_of(F.col("net_pence"), back, F.col("quantity")).alias("credit_net"), part_of(F.col("vat_pence"), back, F.col("quantity")).alias("credit_vat"))


# ---- contracts of facts ----

#: What a fact must keep, by kind; a rule that can't be judged is broken. `sites` is the number of known sites.
CONTRACTS = {
    "appointment": ["month RLIKE '^[0-9]{4}-(0[1-9]|1[0-2])$'", "day BETWEEN DATE'2024-01-01' AND DATE'2024-01-31'", "date_format(day, 'yyyy-MM') = month", "outcome IN ('attended', 'dna', 'late_cancelled', 'booked', 'upcoming', 'unrecorded')", "appointments >= 0 AND minutes >= 0", "site_id BETWEEN 0 AND 3", "practitioner_id IS NULL OR practitioner_id BETWEEN 0 AND 9"],
    "availability": ["minutes >= 0", "booked <= minutes", "site_id BETWEEN 0 AND 3", "practitioner_id IS NOT NULL"],
    "revenue": ["kind IN ('invoiced', 'credited', 'received')", "payer_type IN ('insurer', 'mlc', 'solicitor', 'employer', 'self_pay')", "amount_pence IS NOT NULL", "site_id IS NULL OR site_id BETWEEN 0 AND 4"],
    "debt": ["payer_type IS NOT NULL", "due_on IS NOT NULL", "invoices >= 0", "outstanding_pence IS NOT NULL"],
}


def keep_facts(facts: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(facts that keep their contract, one row with kind, kept and dropped)."""
    fine = F.lit(True)
    for rule in CONTRACTS[kind]:
        fine = fine & F.coalesce(F.expr(rule), F.lit(False))
    judged = facts.withColumn("_fine", fine)
    return judged.where("_fine").drop("_fine"), judged.agg(F.lit(kind).alias("kind"), F.count_if("_fine").alias("kept"), F.count_if(~F.col("_fine")).alias("dropped"))


def _facts_sql(kind: str) -> str:
    rules = " AND ".join(f"coalesce({r}, false)" for r in CONTRACTS[kind]).replace("DATE'", "DATE '").replace("date_format(day, 'yyyy-MM')", "strftime(day, '%Y-%m')").replace("month RLIKE '", "regexp_matches(month, '").replace("2])$'", "2])$')")
    return f"SELECT '{kind}' AS kind, count(*) FILTER ({rules}) AS kept, count(*) FILTER (NOT ({rules})) AS dropped FROM f_{kind}"


@query(sql("appts invoices", """, f_appointment AS (SELECT CASE WHEN appointment_id % 31 = 0 THEN '2024-13' WHEN appointment_id % 37 = 0 THEN '2023-12' ELSE strftime(day, '%Y-%m') END AS month, day, outcome, CASE WHEN appointment_id % 41 = 0 THEN -1 ELSE 1 END AS appointments, minutes, site_id, practitioner_id FROM appts),
f_availability AS (SELECT practitioner_id, site_id, 480 AS minutes, CAST(sum(minutes) AS BIGINT) AS booked FROM appts GROUP BY practitioner_id, site_id, day),
f_revenue AS (SELECT CASE WHEN invoice_id % 11 = 0 THEN 'gift' ELSE 'invoiced' END AS kind, payer_type, total_pence AS amount_pence, site_id FROM invoices),
f_debt AS (SELECT payer_type, due_on, count(*) AS invoices, CASE WHEN sum(balance_pence) % 7 <> 0 THEN CAST(sum(balance_pence) AS BIGINT) END AS outstanding_pence FROM invoices GROUP BY 1, 2)
""" + " UNION ALL ".join(map(_facts_sql, CONTRACTS))))
def fact_contracts(spark, sf_dir):
    """Facts of four kinds, some of them spoilt: how many keep their contract and how many are dropped."""
    a, bills, k = appointments(spark, sf_dir), invoices(spark, sf_dir), F.col("appointment_id")
    month = F.when(k % 31 == 0, "2024-13").when(k % 37 == 0, "2023-12").otherwise(F.date_format("day", "yyyy-MM"))
    facts = {
        "appointment": a.select(month.alias("month"), "day", "outcome", F.when(k % 41 == 0, -1).otherwise(1).alias("appointments"), "minutes", "site_id", "practitioner_id"),
        "availability": a.groupBy("practitioner_id", "site_id", "day").agg(F.sum("minutes").alias("booked")).withColumn("minutes", F.lit(480)),
        "revenue": bills.select(F.when(F.col("invoice_id") % 11 == 0, "gift").otherwise("invoiced").alias("kind"), "payer_type", F.col("total_pence").alias("amount_pence"), "site_id"),
        "debt": bills.groupBy("payer_type", "due_on").agg(F.count("*").alias("invoices"), F.sum("balance_pence").alias("o")).withColumn("outstanding_pence", F.when(F.col("o") % 7 != 0, F.col("o"))),
    }
    out = None
    for kind, rows in facts.items():
        counted = keep_facts(rows, kind)[1]
        out = counted if out is None else out.unionByName(counted)
    return out


# ---- privacy ----


def retention_over(patients: DataFrame, activity: DataFrame, key: str, today: str, years: int) -> DataFrame:
    """Patients whose last activity (key, day) is over `years` back, or who never had any."""
    last = activity.groupBy(key).agg(F.max("day").alias("last_day"))
    return patients.join(last, key, "left").where(F.col("last_day").isNull() | (F.col("last_day") < F.add_months(F.lit(today).cast("date"), -12 * years)))


def anonymise(rows: DataFrame, who: DataFrame, key: str, clear: list[str], at: str) -> DataFrame:
    """The rows with the named columns emptied and `anonymised_at` set where their key is in `who`; figures stay. Rows that
    were done before keep their first instant, so that a second run changes nothing."""
    done = F.col("anonymised_at") if "anonymised_at" in rows.columns else F.lit(None).cast("timestamp")
    marked = rows.withColumn("anonymised_at", done).join(who.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    out = marked.withColumns({c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) for c in clear})
    return out.withColumn("anonymised_at", F.coalesce("anonymised_at", F.when(F.col("_gone"), F.lit(at).cast("timestamp")))).drop("_gone")


@query("""WITH l AS (SELECT c_custkey, max(CAST(o_orderdate AS DATE)) AS last_day, coalesce(bool_or(o_orderstatus <> 'F'), false) AS owes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
w AS (SELECT c_custkey FROM l WHERE (last_day IS NULL OR last_day < DATE '2000-08-01') AND NOT owes)
SELECT c.c_custkey, CASE WHEN w.c_custkey IS NULL THEN c_name END AS c_name, CASE WHEN w.c_custkey IS NULL THEN c_mktsegment END AS c_mktsegment, c_acctbal, w.c_custkey IS NOT NULL AS anonymised FROM customer c LEFT JOIN w ON w.c_custkey = c.c_custkey""")
def anonymised_patients(spark, sf_dir):
    """Patients not seen for a year who owe nothing lose what names them, and no one else does; run twice, as after a stop."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    activity = o.select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    owing = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    who = retention_over(c.select("c_custkey"), activity, "c_custkey", "2001-08-01", 1).join(owing, "c_custkey", "left_anti")
    once = anonymise(c, who, "c_custkey", ["c_name", "c_mktsegment"], "2001-08-01 00:00:00")
    again = anonymise(once, who, "c_custkey", ["c_name", "c_mktsegment"], "2001-08-02 00:00:00")
    return again.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", (F.col("anonymised_at") == F.lit("2001-08-01").cast("timestamp")).alias("a")).withColumn("anonymised", F.coalesce("a", F.lit(False))).drop("a")


def held_on(who: DataFrame, key: str, **tables: tuple[DataFrame, str]) -> DataFrame:
    """Everything held on people: (key, source, row_id, record as JSON). tables: by name the rows and their id column; each
    has the person's key."""
    out = None
    for name, (rows, row_id) in tables.items():
        fields = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
        found = rows.join(who.select(key).distinct(), key, "left_semi").select(F.col(key).cast("long").alias(key), F.lit(name).alias("source"), F.col(row_id).cast("string").alias("row_id"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT c_custkey, 'patient' AS source, CAST(c_custkey AS VARCHAR) AS row_id, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS record FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT o_custkey, 'case', CAST(o_orderkey AS VARCHAR), '{"c_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def subject_access(spark, sf_dir):
    """What is held on each patient of one group, from every table that has their key."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    who = c.where("c_mktsegment = 'BUILDING'")
    return held_on(who, "c_custkey", patient=(c.select("c_custkey", "c_name"), "c_custkey"), case=(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "o_orderkey"))


# ---- rows that must not change, and tenants ----


def breaches(before: DataFrame, after: DataFrame, key: str, sealed: Column | None = None) -> DataFrame:
    """(key, breach) of an append-only table: a row that is gone, or changed though sealed (default: all rows are)."""
    digest = lambda rows: F.xxhash64(*[F.col(c) for c in sorted(before.columns) if c != key])
    old = before.select(key, digest(before).alias("was"), (sealed if sealed is not None else F.lit(True)).alias("sealed"))
    new = after.select(key, digest(after).alias("now"), F.lit(True).alias("there"))
    met = old.join(new, key, "left")
    kind = F.when(F.col("there").isNull(), "deleted").when(F.col("sealed") & (F.col("was") != F.col("now")), "changed")
    return met.withColumn("breach", kind).where("breach IS NOT NULL").select(key, "breach")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'deleted' ELSE 'changed' END AS breach FROM orders WHERE o_orderkey % 97 = 0 OR (o_orderkey % 89 = 0 AND o_orderstatus = 'F')")
def sealed_rows(spark, sf_dir):
    """A later copy of a table in which rows went and changed; a change of an unsealed row is none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    later = o.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return breaches(o, later, "o_orderkey", F.col("o_orderstatus") == "F")


def of_tenant(rows: DataFrame, tenant: int | str, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant; a table without the column, or no tenant, is an error, never all rows."""
    if column not in rows.columns or tenant is None or tenant == "":
        raise ValueError(f"{column}: every read names its tenant")
    return rows.where(F.col(column) == F.lit(tenant))


@query("SELECT s_suppkey, s_nationkey AS tenant_id, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS patients FROM supplier WHERE s_nationkey = 3")
def tenant_rows(spark, sf_dir):
    """One tenant's clinics and how many patients the tenant has; both sides of the join are the tenant's."""
    s = of_tenant(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "tenant_id"), 3)
    c = of_tenant(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "tenant_id"), 3).groupBy("tenant_id").agg(F.count("*").alias("patients"))
    return s.join(c, "tenant_id", "left").select("s_suppkey", "tenant_id", F.coalesce("patients", F.lit(0)).alias("patients"))
