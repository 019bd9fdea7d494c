"""Opening hours and closures: open minutes, windows clipped to them, working-hours checks, utilisation of sites and rooms,
free slots of a practitioner and a room, and the sources that reports draw on.

A site without any session has no hours set: nothing limits it. A closure, of one site or of all, empties its days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.plans.attendance import ratio
from wardflow.registry import query
from wardflow.sources.tables import appointments, sql

#: Weekdays Monday 1 to Sunday 7, minutes of the day. Sites 0 to 3 have hours, site 4 has none set.
SESSIONS = [(site, day, 480, 720) for site in range(4) for day in range(1, 6)] + [(site, day, 780, 1080 + 60 * site) for site in range(4) for day in range(1, 6)] + [(site, 6, 540, 780) for site in (0, 1)]
#: Site (null: every site), first and last day.
CLOSURES = [(None, "2024-01-01", "2024-01-01"), (2, "2024-01-10", "2024-01-12"), (3, "2024-01-15", "2024-01-15"), (4, "2024-01-20", "2024-01-21")]
FIRST, LAST = "2024-01-01", "2024-01-31"


def sessions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SESSIONS, "site_id long, weekday int, opens int, closes int")


def closures_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLOSURES, "site_id long, starts string, ends string").select("site_id", F.col("starts").cast("date").alias("starts"), F.col("ends").cast("date").alias("ends"))


def closed_days(sites: DataFrame, closures: DataFrame) -> DataFrame:
    """(site_id, day) of every closed day: closures of all sites are dealt to each site."""
    everywhere = closures.where("site_id IS NULL").drop("site_id").crossJoin(sites.select("site_id").distinct())
    own = closures.where("site_id IS NOT NULL")
    return own.unionByName(everywhere).select("site_id", F.explode(F.sequence("starts", "ends")).alias("day")).distinct()


def open_sessions(sites: DataFrame, sessions: DataFrame, closures: DataFrame, first: str, last: str) -> DataFrame:
    """(site_id, day, opens, closes) of each session in a period, closed days left out. Directories, not facts: a row for
    each site, day and session."""
    days = sites.select("site_id").distinct().select("site_id", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).withColumn("weekday", F.weekday("day") + 1)
    return days.join(sessions, ["site_id", "weekday"]).join(closed_days(sites, closures), ["site_id", "day"], "left_anti").select("site_id", "day", "opens", "closes")


def open_minutes(sites: DataFrame, sessions: DataFrame, closures: DataFrame, first: str, last: str) -> DataFrame:
    """(site_id, day, minutes) for every day of the period; a closed day has 0."""
    days = sites.select("site_id").distinct().select("site_id", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    found = open_sessions(sites, sessions, closures, first, last).groupBy("site_id", "day").agg(F.sum(F.col("closes") - F.col("opens")).alias("minutes"))
    return days.join(found, ["site_id", "day"], "left").fillna(0, ["minutes"])


def clip_windows(windows: DataFrame, sessions: DataFrame, closures: DataFrame) -> DataFrame:
    """Working windows (site_id, day, s, e and others) cut to the sessions of their site and day. The window's own weekday
    meets the sessions, so no calendar is built."""
    sites = windows.select("site_id").distinct()
    limited = sessions.select("site_id").distinct().withColumn("limited", F.lit(True))
    left = windows.join(closed_days(sites, closures), ["site_id", "day"], "left_anti").join(limited, "site_id", "left")
    free = left.where("limited IS NULL").drop("limited")
    cut = left.where("limited").drop("limited").withColumn("weekday", F.weekday("day") + 1).join(sessions, ["site_id", "weekday"]).drop("weekday")
    cut = cut.withColumns({"s": F.greatest("s", "opens"), "e": F.least("e", "closes")}).where("e > s").drop("opens", "closes")
    return free.unionByName(cut)


_HOURS = """, sites AS (SELECT DISTINCT site_id FROM appts),
sessions AS (SELECT * FROM (VALUES {sessions}) AS v(site_id, weekday, opens, closes)),
closures AS (SELECT site_id, CAST(a AS DATE) AS starts, CAST(b AS DATE) AS ends FROM (VALUES {closures}) AS v(site_id, a, b)),
days AS (SELECT site_id, CAST(d AS DATE) AS day FROM sites, (SELECT unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS d)),
opened AS (SELECT days.site_id, day, opens, closes FROM days JOIN sessions ON sessions.site_id = days.site_id AND weekday = isodow(day) WHERE NOT EXISTS (SELECT 1 FROM closures c WHERE (c.site_id IS NULL OR c.site_id = days.site_id) AND day BETWEEN starts AND ends))
""".format(sessions=", ".join(map(str, SESSIONS)), closures=", ".join(f"({'NULL' if s is None else s}, '{a}', '{b}')" for s, a, b in CLOSURES), first=FIRST, last=LAST)
_ROOMED = ", roomed AS (SELECT *, site_id + 5 * (appointment_id % 2) AS room_id, CAST((starts_us % 86400000000) // 60000000 AS BIGINT) AS s, CAST((starts_us % 86400000000) // 60000000 + minutes AS BIGINT) AS e FROM appts)\n"


def _roomed(spark, sf_dir) -> DataFrame:
    """Appointments with a room of their site and local minutes (s, e); every site has two rooms."""
    a = appointments(spark, sf_dir)
    start = F.floor(F.col("starts_us") % 86_400_000_000 / 60_000_000)
    return a.withColumns({"room_id": F.col("site_id") + 5 * (F.col("appointment_id") % 2), "s": start, "e": start + F.col("minutes")})


def _directory(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return appointments(spark, sf_dir).select("site_id").distinct(), sessions_table(spark), closures_table(spark)


@query(sql("appts", _HOURS + "SELECT days.site_id, days.day, CAST(coalesce(sum(closes - opens), 0) AS BIGINT) AS minutes FROM days LEFT JOIN opened USING (site_id, day) GROUP BY 1, 2"))
def opening_minutes(spark, sf_dir):
    """Open minutes of each site and day of a month."""
    return open_minutes(*_directory(spark, sf_dir), FIRST, LAST)


# a practitioner works 07:30-12:30 and 13:00-20:00 at the site of the day's first booking
_WINDOWS = ", windows AS (SELECT site_id, practitioner_id, day, w[1] AS s, w[2] AS e FROM (SELECT practitioner_id, day, arg_min(site_id, (starts_us, appointment_id)) AS site_id FROM appts GROUP BY 1, 2), (SELECT unnest([[450, 750], [780, 1200]]) AS w))\n"
_CLIPPED = """, clipped AS (SELECT w.site_id, practitioner_id, w.day, greatest(s, opens) AS s, least(e, closes) AS e FROM windows w JOIN sessions x ON x.site_id = w.site_id AND x.weekday = isodow(w.day)
WHERE least(e, closes) > greatest(s, opens) AND NOT EXISTS (SELECT 1 FROM closures c WHERE (c.site_id IS NULL OR c.site_id = w.site_id) AND w.day BETWEEN starts AND ends)
UNION ALL SELECT site_id, practitioner_id, day, s, e FROM windows w WHERE site_id NOT IN (SELECT site_id FROM sessions) AND NOT EXISTS (SELECT 1 FROM closures c WHERE (c.site_id IS NULL OR c.site_id = w.site_id) AND w.day BETWEEN starts AND ends))
"""


def _windows(spark, sf_dir) -> DataFrame:
    at = appointments(spark, sf_dir).groupBy("practitioner_id", "day").agg(F.min_by("site_id", F.struct("starts_us", "appointment_id")).alias("site_id"))
    spans = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((450, 750), (780, 1200))])
    return at.withColumn("w", F.explode(spans)).select("site_id", "practitioner_id", "day", "w.s", "w.e")


@query(sql("appts", _HOURS + _WINDOWS + _CLIPPED + "SELECT * FROM clipped"))
def clipped_windows(spark, sf_dir):
    """Working windows cut to opening hours; a closure takes the day away, a site without hours keeps its windows."""
    return clip_windows(_windows(spark, sf_dir), sessions_table(spark), closures_table(spark))


def within_windows(spans: DataFrame, windows: DataFrame, *key: str) -> DataFrame:
    """Adds `inside`: whether [s, e) of each row (id and key) lies in one window of its key."""
    held = windows.select(*key, F.col("s").alias("from_"), F.col("e").alias("to_"))
    met = spans.select("id", *key, "s", "e").join(held, list(key)).where("from_ <= s AND e <= to_").select("id").distinct().withColumn("inside", F.lit(True))
    return spans.join(met, "id", "left").fillna(False, ["inside"])


@query(sql("appts", _HOURS + _WINDOWS + _CLIPPED + _ROOMED + "SELECT appointment_id, EXISTS (SELECT 1 FROM clipped c WHERE c.practitioner_id = r.practitioner_id AND c.day = r.day AND c.s <= r.s AND r.e <= c.e) AS inside FROM roomed r"))
def within_working_hours(spark, sf_dir):
    """Bookings that lie wholly in one working window of their practitioner."""
    windows = clip_windows(_windows(spark, sf_dir), sessions_table(spark), closures_table(spark))
    spans = _roomed(spark, sf_dir).withColumn("id", F.col("appointment_id"))
    return within_windows(spans, windows, "practitioner_id", "day").select("appointment_id", "inside")


def utilisation(appts: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Booked, attended and available minutes of each key, with the rate (null where no time was available). Bookings that
    were cancelled in time hold no slot."""
    held = appts.where("outcome <> 'cancelled'").groupBy(key).agg(F.sum("minutes").alias("booked"), F.sum(F.when(F.col("outcome") == "attended", F.col("minutes")).otherwise(0)).alias("attended"), F.count("*").alias("appointments"))
    out = held.join(available, key, "full").fillna(0, ["booked", "attended", "appointments"])
    return out.withColumn("rate", ratio(F.col("booked"), F.col("available")))


_PERIOD = f"day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
_USED = "(SELECT {k}, CAST(sum(minutes) AS BIGINT) AS booked, CAST(sum(CASE WHEN outcome = 'attended' THEN minutes ELSE 0 END) AS BIGINT) AS attended, count(*) AS appointments FROM roomed WHERE outcome <> 'cancelled' AND " + _PERIOD + " GROUP BY 1)"
_RATE = "CASE WHEN available > 0 THEN booked / available END AS rate"


@query(sql("appts", _HOURS + _ROOMED + f""", av AS (SELECT s.site_id, nullif(coalesce((SELECT CAST(sum(closes - opens) AS BIGINT) FROM opened o WHERE o.site_id = s.site_id), 0), 0) * greatest(1, (SELECT count(DISTINCT room_id) FROM roomed r WHERE r.site_id = s.site_id)) AS available FROM sites s)
SELECT site_id, coalesce(booked, 0) AS booked, coalesce(attended, 0) AS attended, coalesce(appointments, 0) AS appointments, available, {_RATE} FROM av LEFT JOIN {_USED.format(k="site_id")} USING (site_id)"""))
def utilisation_by_site(spark, sf_dir):
    """Available time of a site: its open minutes times its rooms."""
    a = _roomed(spark, sf_dir)
    rooms = a.groupBy("site_id").agg(F.countDistinct("room_id").alias("rooms"))
    hours = open_minutes(*_directory(spark, sf_dir), FIRST, LAST).groupBy("site_id").agg(F.sum("minutes").alias("open"))
    available = hours.join(rooms, "site_id", "left").select("site_id", F.when(F.col("open") > 0, F.col("open") * F.greatest(F.lit(1), F.coalesce("rooms", F.lit(1)))).alias("available"))
    return utilisation(a.where(_PERIOD), available, "site_id")


@query(sql("appts", _HOURS + _ROOMED + f""", av AS (SELECT room_id, nullif(coalesce((SELECT CAST(sum(closes - opens) AS BIGINT) FROM opened o WHERE o.site_id = s.site_id), 0), 0) AS available FROM (SELECT DISTINCT site_id, room_id FROM roomed) s)
SELECT room_id, coalesce(booked, 0) AS booked, coalesce(attended, 0) AS attended, coalesce(appointments, 0) AS appointments, available, {_RATE} FROM av LEFT JOIN {_USED.format(k="room_id")} USING (room_id)"""))
def utilisation_by_room(spark, sf_dir):
    """Available time of a room: the open minutes of its site."""
    a = _roomed(spark, sf_dir)
    hours = open_minutes(*_directory(spark, sf_dir), FIRST, LAST).groupBy("site_id").agg(F.sum("minutes").alias("open"))
    available = a.select("site_id", "room_id").distinct().join(hours, "site_id", "left").select("room_id", F.when(F.col("open") > 0, F.col("open")).alias("available"))
    return utilisation(a.where(_PERIOD), available, "room_id")


def free_room_slots(windows: DataFrame, busy: DataFrame, duration: int, step: int = 15) -> DataFrame:
    """Starts (minutes) at multiples of `step` at which a practitioner and the window's room are both free for `duration`.

    windows: practitioner_id, room_id (null: any), day, s, e. busy: practitioner_id, room_id, day, s, e. Each busy span
    names the starts that it takes, so two anti joins on equal keys find what is left.
    """
    first = F.ceil(F.col("s") / step) * step
    starts = windows.where(first + duration <= F.col("e")).withColumn("start", F.explode(F.sequence(first, F.col("e").cast("long") - duration, F.lit(step).cast("long"))))
    low, high = (F.floor((F.col("s") - duration) / step) + 1) * step, (F.ceil(F.col("e") / step) - 1) * step
    taken = busy.where(high >= low).withColumn("start", F.explode(F.sequence(low, high, F.lit(step).cast("long"))))
    of = lambda key: taken.where(F.col(key).isNotNull()).select(key, "day", "start").distinct()
    return starts.join(of("practitioner_id"), ["practitioner_id", "day", "start"], "left_anti").join(of("room_id"), ["room_id", "day", "start"], "left_anti")


@query(sql("appts", _HOURS + _WINDOWS + _CLIPPED + _ROOMED + """, g AS (SELECT site_id, practitioner_id, site_id + 5 * (practitioner_id % 2) AS room_id, day, unnest(generate_series(CAST(ceil(s / 20) * 20 AS BIGINT), e - 45, 20)) AS start FROM clipped)
SELECT site_id, practitioner_id, room_id, day, start FROM g WHERE NOT EXISTS (SELECT 1 FROM roomed b WHERE b.day = g.day AND (b.practitioner_id = g.practitioner_id OR b.room_id = g.room_id) AND b.s < g.start + 45 AND b.e > g.start)"""))
def free_slots_with_room(spark, sf_dir):
    """Starts every 20 minutes at which 45 minutes are free for the practitioner and the room, inside opening hours."""
    windows = clip_windows(_windows(spark, sf_dir), sessions_table(spark), closures_table(spark)).withColumn("room_id", F.col("site_id") + 5 * (F.col("practitioner_id") % 2))
    return free_room_slots(windows, _roomed(spark, sf_dir).select("practitioner_id", "room_id", "day", "s", "e"), 45, 20).select("site_id", "practitioner_id", "room_id", "day", "start")


def earliest(slots: DataFrame, most: int, *key: str) -> DataFrame:
    """The first `most` slots of each key: a report's top rows."""
    w = Window.partitionBy(*key).orderBy("day", "start")
    return slots.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


@query(sql("appts", _HOURS + _WINDOWS + _CLIPPED + _ROOMED + """, g AS (SELECT site_id, practitioner_id, site_id + 5 * (practitioner_id % 2) AS room_id, day, unnest(generate_series(CAST(ceil(s / 15) * 15 AS BIGINT), e - 60, 15)) AS start FROM clipped WHERE day >= DATE '2024-01-08'),
f AS (SELECT practitioner_id, day, start FROM g WHERE NOT EXISTS (SELECT 1 FROM roomed b WHERE b.day = g.day AND (b.practitioner_id = g.practitioner_id OR b.room_id = g.room_id) AND b.s < g.start + 60 AND b.e > g.start))
SELECT practitioner_id, day, start, n FROM (SELECT *, row_number() OVER (PARTITION BY practitioner_id ORDER BY day, start) AS n FROM f) WHERE n <= 3"""))
def next_free_slots(spark, sf_dir):
    """The three next free hours of each practitioner from a day on."""
    windows = clip_windows(_windows(spark, sf_dir).where("day >= DATE'2024-01-08'"), sessions_table(spark), closures_table(spark)).withColumn("room_id", F.col("site_id") + 5 * (F.col("practitioner_id") % 2))
    return earliest(free_room_slots(windows, _roomed(spark, sf_dir).select("practitioner_id", "room_id", "day", "s", "e"), 60), 3, "practitioner_id").select("practitioner_id", "day", "start", "n")


class Sources:
    """What reports draw on: functions (spark, sf_dir) -> DataFrame by kind. A kind that is set to None, or never set, is not
    available: reports over it come out empty with `available` false instead of failing."""

    def __init__(self, **kinds: Callable | None):
        self._kinds = dict(kinds)

    def register(self, kind: str, source: Callable | None) -> None:
        self._kinds[kind] = source

    def facts(self, kind: str, spark: SparkSession, sf_dir: str) -> DataFrame | None:
        source = self._kinds.get(kind)
        return source(spark, sf_dir) if source else None

    def report(self, spark: SparkSession, sf_dir: str, figures: dict[str, tuple[str, Column]]) -> DataFrame:
        """One row for each figure (name to kind and aggregate): name, available, value."""
        rows = None
        for name, (kind, figure) in figures.items():
            facts = self.facts(kind, spark, sf_dir)
            one = spark.range(1).select(F.lit(None).cast("double").alias("value")) if facts is None else facts.agg(figure.cast("double").alias("value"))
            one = one.select(F.lit(name).alias("name"), F.lit(facts is not None).alias("available"), "value")
            rows = one if rows is None else rows.unionByName(one)
        return rows


@query(sql("appts invoices", "SELECT 'attended' AS name, true AS available, CAST(count(*) FILTER (outcome = 'attended') AS DOUBLE) AS value FROM appts UNION ALL SELECT 'owed', true, CAST(sum(balance_pence) AS DOUBLE) FROM invoices UNION ALL SELECT 'stock', false, NULL"))
def report_sources(spark, sf_dir):
    """Figures of two sources, and of one that is not there."""
    from wardflow.sources.tables import invoices

    sources = Sources(diary=appointments, billing=invoices, stock=lambda spark, sf_dir: spark.range(0))
    sources.register("stock", None)
    return sources.report(spark, sf_dir, {"attended": ("diary", F.count_if(F.col("outcome") == "attended")), "owed": ("billing", F.sum("balance_pence")), "stock": ("stock", F.count("*"))})
