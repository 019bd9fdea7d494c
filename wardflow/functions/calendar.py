"""Periods, recurring dates, rotas and reminder times as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.scalars import ZONE, from_local
from wardflow.registry import query
from wardflow.sources.tables import NOW, appointments, micros, sql, table

#: Limits of a series and of a period, and how near its appointment a reminder may go.
MAX_WEEKS_APART, MAX_OCCURRENCES, MAX_PERIOD_DAYS = 8, 52, 367
LEAST_LEAD_MINUTES, CUTOFF_MINUTES, EARLIER_MINUTES = 60, 30, 15
MINUTE_US = 60_000_000


def monday(day: Column) -> Column:
    return F.trunc(day, "week")


def preset_bounds(today: Column) -> dict[str, tuple[Column, Column]]:
    """First and last day of each named period around `today`; weeks start on Monday, quarters with the calendar."""
    week, month, quarter = monday(today), F.trunc(today, "month"), F.trunc(today, "quarter")
    end_of = lambda first, months: F.date_sub(F.add_months(first, months), 1)
    return {
        "this_week": (week, F.date_add(week, 6)),
        "last_week": (F.date_sub(week, 7), F.date_sub(week, 1)),
        "last_6_weeks": (F.date_sub(week, 35), F.date_add(week, 6)),
        "this_month": (month, end_of(month, 1)),
        "last_month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "last_30_days": (F.date_sub(today, 29), today),
        "this_quarter": (quarter, end_of(quarter, 3)),
        "last_quarter": (F.add_months(quarter, -3), F.date_sub(quarter, 1)),
        "last_12_months": (F.add_months(month, -11), end_of(month, 1)),
        "this_year": (F.trunc(today, "year"), end_of(F.trunc(today, "year"), 12)),
    }


def custom_period(first: Column, last: Column) -> Column:
    """Struct (first, last, days) of a period somebody chose; null if it runs backwards or is longer than a year."""
    days = F.datediff(last, first) + 1
    return F.when((days >= 1) & (days <= MAX_PERIOD_DAYS), F.struct(first.alias("first"), last.alias("last"), days.alias("days")))


def recurring(first: Column, weeks_apart: Column, times: Column) -> Column:
    """Dates of a series, both numbers held within their limits."""
    step = F.greatest(F.lit(1), F.least(F.lit(MAX_WEEKS_APART), weeks_apart)).cast("int") * 7
    last = F.greatest(F.lit(1), F.least(F.lit(MAX_OCCURRENCES), times)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.date_add(first, k * step))


def rota_days(rules: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day in [first, last] on which a rule works. Rules: weekday (Monday 1), every_weeks counted from the
    week of valid_from, valid_from, valid_to (null: no end). Days are stepped through, not tested one by one."""
    from_, to, step = F.col("valid_from"), F.least(F.col("valid_to"), F.lit(last).cast("date")), F.greatest(F.col("every_weeks"), F.lit(1)).cast("int") * 7
    start = F.date_add(monday(from_), (F.col("weekday") - 1).cast("int"))
    behind = F.greatest(F.datediff(F.greatest(from_, F.lit(first).cast("date")), start), F.lit(0))
    start = F.date_add(start, (F.ceil(behind / step) * step).cast("int"))
    steps = F.floor(F.datediff(to, start) / step).cast("int")
    days = F.when(steps >= 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: F.date_add(start, k * step)))
    return rules.withColumn("day", F.explode(days))


def ever_together(weekday: Column, every_a: Column, from_a: Column, every_b: Column, from_b: Column, to: Column) -> Column:
    """Whether two rules of one weekday fall on one day up to `to` (null: no end). Their weeks come together within
    every_a * every_b weeks of the later start or never."""
    later = F.greatest(from_a, from_b)
    first = F.date_add(later, F.pmod(weekday - 1 - F.weekday(later), F.lit(7)).cast("int"))

    def both(k: Column) -> Column:
        day = F.date_add(first, k * 7)
        on = lambda since, every: F.pmod((F.datediff(monday(day), monday(since)) / 7).cast("int"), every.cast("int")) == 0
        return on(from_a, every_a) & on(from_b, every_b) & (to.isNull() | (day <= to))

    return F.exists(F.sequence(F.lit(0), (every_a * every_b - 1).cast("int")), both)


def reminder_due(starts: Column, hours_before: Column, days_before: Column, at_minute: Column) -> Column:
    """Instant a reminder is due: so many hours before, else at a minute of the UK day so many days before."""
    local_day = F.to_date(F.from_utc_timestamp(starts, ZONE))
    wall = F.to_timestamp(F.date_sub(local_day, days_before.cast("int"))) + F.make_dt_interval(mins=at_minute)
    return F.when(hours_before > 0, starts - F.make_dt_interval(hours=hours_before)).when(days_before > 0, from_local(wall))


def out_of_quiet(due: Column, starts: Column, quiet_from: int, quiet_to: int) -> Column:
    """Moves a due time out of the quiet minutes [from, to) of the UK day, which may pass midnight: to their end if that
    leaves an hour before the appointment, else to a quarter of an hour before they begin."""
    if quiet_from == quiet_to:
        return due
    local = F.from_utc_timestamp(due, ZONE)
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    quiet = (minute >= quiet_from) & (minute < quiet_to) if quiet_from < quiet_to else (minute >= quiet_from) | (minute < quiet_to)
    wall = lambda d, m: from_local(F.to_timestamp(d) + F.make_dt_interval(mins=F.lit(m)))
    forward = wall(F.when(minute < quiet_to, day).otherwise(F.date_add(day, 1)), quiet_to)
    back = wall(F.when(minute >= quiet_from, day).otherwise(F.date_sub(day, 1)), quiet_from) - F.make_dt_interval(mins=F.lit(EARLIER_MINUTES))
    return F.when(~quiet, due).when(forward <= starts - F.make_dt_interval(mins=F.lit(LEAST_LEAD_MINUTES)), forward).otherwise(back)


_BOUNDS = """this_week w w+6|last_week w-7 w-1|last_6_weeks w-35 w+6|this_month m e|last_month m-1M m-1|last_30_days day-29 day|this_quarter q q+3M-1|last_quarter q-3M q-1|last_12_months m-11M e|this_year y y+12M-1"""


def _presets_sql() -> str:
    date = {"w": "date_trunc('week', day)", "m": "date_trunc('month', day)", "q": "date_trunc('quarter', day)", "y": "date_trunc('year', day)", "day": "day", "e": "last_day(day)"}

    def bound(text: str) -> str:
        name, *moves = text.replace("-", " -").replace("+", " +").split()
        out = f"CAST({date[name]} AS DATE)"
        for m in moves:
            sign, n = m[0], m[1:]
            out = f"CAST({out} {sign} INTERVAL {n[:-1]} MONTH AS DATE)" if n.endswith("M") else f"({out} {sign} {n})"
        return out

    parts = [p.split() for p in _BOUNDS.split("|")]
    return " UNION ALL ".join(f"SELECT day, '{name}' AS preset, {bound(a)} AS first_day, {bound(b)} AS last_day FROM d" for name, a, b in parts)


@query(f"WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) {_presets_sql()}")
def period_presets(spark, sf_dir):
    """Bounds of every named period for each order day."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    rows = F.array(*[F.struct(F.lit(k).alias("preset"), a.alias("first_day"), b.alias("last_day")) for k, (a, b) in preset_bounds(F.col("day")).items()])
    return days.select("day", F.inline(rows))


@query("""SELECT s_suppkey, CAST(DATE '2024-01-01' + CAST(s_suppkey % 90 AS INTEGER) + CAST(k * 7 * least(8, greatest(1, s_nationkey)) AS INTEGER) AS DATE) AS day
FROM supplier, generate_series(0, 51) AS g(k) WHERE k < greatest(1, least(52, s_suppkey % 60))""")
def recurring_dates(spark, sf_dir):
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 90).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(recurring(first, F.col("s_nationkey"), F.col("s_suppkey") % 60)).alias("day"))


def _rules(spark, sf_dir) -> DataFrame:
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("rule_id"), (key % 4).alias("practitioner_id"), (1 + key % 7).alias("weekday"), (1 + key % 3).alias("every_weeks"), (480 + 60 * (key % 4)).alias("from_minute"), (720 + 60 * (key % 5)).alias("to_minute"),
        day("2023-12-01", key % 60).alias("valid_from"), F.when(key % 4 != 0, day("2024-02-01", key % 90)).alias("valid_to"))


_RULES = """rules AS (SELECT s_suppkey AS rule_id, s_suppkey % 4 AS practitioner_id, 1 + s_suppkey % 7 AS weekday, 1 + s_suppkey % 3 AS every_weeks, 480 + 60 * (s_suppkey % 4) AS from_minute, 720 + 60 * (s_suppkey % 5) AS to_minute,
  DATE '2023-12-01' + CAST(s_suppkey % 60 AS INTEGER) AS valid_from, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-02-01' + CAST(s_suppkey % 90 AS INTEGER) END AS valid_to FROM supplier),
worked AS (SELECT r.*, d AS day FROM rules r, (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2023-12-01', DATE '2024-08-31', INTERVAL 1 DAY) AS g(x))
  WHERE isodow(d) = weekday AND d >= valid_from AND (valid_to IS NULL OR d <= valid_to) AND (date_trunc('week', d)::DATE - date_trunc('week', valid_from)::DATE) // 7 % every_weeks = 0)"""


@query(f"WITH {_RULES} SELECT rule_id, practitioner_id, day, from_minute, to_minute FROM worked WHERE day BETWEEN '2024-01-01' AND '2024-01-31'")
def rota_windows(spark, sf_dir):
    """Working windows of a month."""
    return rota_days(_rules(spark, sf_dir), "2024-01-01", "2024-01-31").select("rule_id", "practitioner_id", "day", "from_minute", "to_minute")


@query(f"""WITH {_RULES} SELECT DISTINCT a.rule_id AS a, b.rule_id AS b FROM worked a JOIN worked b ON a.practitioner_id = b.practitioner_id AND a.day = b.day AND a.rule_id < b.rule_id
WHERE a.from_minute < b.to_minute AND b.from_minute < a.to_minute""")
def rota_clashes(spark, sf_dir):
    """Pairs of a practitioner's rules that are ever in force together. Rules that differ in their id only are one class; classes meet by practitioner
    and weekday, and what holds for two classes holds for all their rules."""
    r = _rules(spark, sf_dir)
    rule = [c for c in r.columns if c != "rule_id"]
    classes = r.select(*rule).distinct()
    pick = lambda p: classes.select("practitioner_id", "weekday", F.struct(*rule).alias(p))
    both = pick("a").join(pick("b"), ["practitioner_id", "weekday"]).where("a <= b AND a.from_minute < b.to_minute AND b.from_minute < a.to_minute")
    ends = F.least("a.valid_to", "b.valid_to")
    meet = both.where(ever_together(F.col("weekday"), F.col("a.every_weeks"), F.col("a.valid_from"), F.col("b.every_weeks"), F.col("b.valid_from"), ends)).select("a", "b", (F.col("a") == F.col("b")).alias("same"))
    member = lambda p: r.select(F.struct(*rule).alias(p), F.col("rule_id").alias(f"{p}_id"))
    found = meet.join(member("a"), "a").join(member("b"), "b").where("a_id < b_id OR (a_id > b_id AND NOT same)")
    return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


@query(sql("appts", f"""SELECT appointment_id, quiet AS held, CASE WHEN NOT quiet THEN due WHEN forward <= starts_us - 3600000000 THEN forward ELSE back END AS due_us,
epoch_us(TIMESTAMP '{NOW}') <= starts_us - 1800000000 AS worth_sending
FROM (SELECT *, m >= 1260 OR m < 480 AS quiet, d0 + CASE WHEN m < 480 THEN 0 ELSE 86400000000 END + 28800000000 AS forward, d0 - CASE WHEN m >= 1260 THEN 0 ELSE 86400000000 END + 74700000000 AS back
FROM (SELECT *, due // 86400000000 * 86400000000 AS d0, due % 86400000000 // 60000000 AS m
FROM (SELECT *, CASE WHEN patient_id % 2 = 0 THEN starts_us - 86400000000 ELSE (starts_us // 86400000000 - 2) * 86400000000 + 34200000000 END AS due FROM appts)))"""))
def reminders_due(spark, sf_dir):
    """Texts 24 hours before, or at 09:30 two days before, moved out of 21:00 to 08:00; these bookings are in winter."""
    a = appointments(spark, sf_dir)
    starts, even = F.timestamp_micros("starts_us"), F.col("patient_id") % 2 == 0
    due = reminder_due(starts, F.when(even, 24), F.when(~even, 2), F.lit(570))
    moved = out_of_quiet(F.col("due"), F.col("starts"), 21 * 60, 8 * 60)
    worth = micros(F.lit(NOW).cast("timestamp_ntz")) <= F.col("starts_us") - CUTOFF_MINUTES * MINUTE_US
    return a.select("appointment_id", "starts_us", starts.alias("starts"), due.alias("due")).select("appointment_id", (moved != F.col("due")).alias("held"), F.unix_micros(moved).alias("due_us"), worth.alias("worth_sending"))


@query("SELECT o_orderkey, epoch_us(CAST(o_orderdate AS DATE)) + 1800000000 - CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 3600000000 ELSE 0 END AS starts_us FROM orders WHERE month(o_orderdate) NOT IN (3, 10)")
def local_instants(spark, sf_dir):
    """Instant of 00:30 on a UK day; the months in which clocks change are left to the tests by hand."""
    wall = F.to_timestamp(F.to_date("o_orderdate")) + F.make_dt_interval(mins=F.lit(30))
    return table(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(3, 10)).select("o_orderkey", F.unix_micros(from_local(wall)).alias("starts_us"))


def local_day_pieces(rows: DataFrame) -> DataFrame:
    """Cuts spans (s, e), in microseconds, at UK midnights; adds `day`. A day of 23 or 25 hours is one piece."""
    day_of = lambda us: F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), ZONE))
    midnight = lambda d: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(d), ZONE))
    cut = rows.where("s < e").withColumn("day", F.explode(F.sequence(day_of(F.col("s")), day_of(F.col("e") - 1))))
    return cut.withColumns({"s": F.greatest("s", midnight(F.col("day"))), "e": F.least("e", midnight(F.date_add("day", 1)))})


@query(sql("appts", """SELECT appointment_id, CAST(make_timestamp(d * 86400000000) AS DATE) AS day, greatest(s, d * 86400000000) AS s, least(e, (d + 1) * 86400000000) AS e
FROM (SELECT appointment_id, starts_us AS s, starts_us + 40 * 3600000000 AS e, unnest(generate_series(starts_us // 86400000000, (starts_us + 40 * 3600000000 - 1) // 86400000000)) AS d FROM appts)"""))
def stays_by_local_day(spark, sf_dir):
    """Stays of 40 hours cut at midnights."""
    stays = appointments(spark, sf_dir).select("appointment_id", F.col("starts_us").alias("s"), (F.col("starts_us") + 40 * 60 * MINUTE_US).alias("e"))
    return local_day_pieces(stays).select("appointment_id", "day", "s", "e")
