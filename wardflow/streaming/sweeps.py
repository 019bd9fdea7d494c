"""Polled jobs: sweeps from a mark, queues that take an item once, expiry, retention, upserts, usage and margins, adherence."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import AS_OF, NOW, appointments, invoices, micros, sql, table
from wardflow.streaming.jobs import events, work_folder

#: A sweep looks back this far behind its mark, for rows that were written late.
OVERLAP_US = 2 * 3_600_000_000
MARK = "2024-01-20 00:00:00"


def sweep(rows: DataFrame, at: Column, mark: Column, now: Column, overlap: int = OVERLAP_US) -> DataFrame:
    """Rows written in (mark - overlap, now]; the next mark is the latest `at` among them."""
    return rows.where((at > mark - overlap) & (at <= now))


def not_queued(items: DataFrame, queue: DataFrame, item_id: str) -> DataFrame:
    """Items whose id isn't in the queue, each once."""
    return items.dropDuplicates([item_id]).join(queue.select(item_id), item_id, "left_anti")


#: Folders of a queue, by a hash of the id.
QUEUE_PARTS = 64


def queue_stream(items: DataFrame, item_id: str, path: str, checkpoint: str, parts: int = QUEUE_PARTS) -> None:
    """Takes what a stream of items holds now into a Parquet queue, each id once, whenever it is offered. The queue has a folder for each
    hash of ids, and a batch reads those of its own ids only. A batch that is run again after a lost driver finds its own ids there
    and adds none."""
    spark, schema = items.sparkSession, items.schema
    hashed = F.pmod(F.xxhash64(F.col(item_id)), F.lit(parts)).cast("int")

    def take(batch: DataFrame, _: int) -> None:
        dealt = batch.withColumn("part", hashed)
        # at most `parts` numbers come to the driver
        touched = [r[0] for r in dealt.select("part").distinct().collect()]
        held = spark.read.schema(dealt.schema).parquet(path).where(F.col("part").isin(touched))
        not_queued(dealt, held, item_id).write.mode("append").partitionBy("part").parquet(path)

    spark.createDataFrame([], schema).withColumn("part", F.lit(0)).write.mode("ignore").partitionBy("part").parquet(path)
    items.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of target, those with a changed key replaced, and the new ones."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def update_if(target: DataFrame, changes: DataFrame, key: str, rev: str, value: str) -> DataFrame:
    """Sets value where the change expects the row's revision, and counts the revision up; other changes have no effect.
    Changes hold at most one row a key."""
    c = changes.select(key, F.col(rev).alias("_expected"), F.col(value).alias("_value"))
    hit = F.coalesce(F.col(rev) == F.col("_expected"), F.lit(False))
    return target.join(c, key, "left").withColumns({value: F.when(hit, F.col("_value")).otherwise(F.col(value)), rev: F.col(rev) + hit.cast("long")}).drop("_expected", "_value")


def page_at(df: DataFrame, order: list[Column | str], offset: int, size: int) -> DataFrame:
    """A page of rows and the total of all."""
    return df.orderBy(*order).offset(offset).limit(size).withColumn("total", df.agg(F.count("*")).scalar())


def token_cost(model: Column, tokens: Column, prices: dict[str, float]) -> Column:
    """Whole micro-dollars of a call; a model that isn't listed costs what the dearest does."""
    price = F.lit(float(max(prices.values())))
    for name, each in prices.items():
        price = F.when(F.lower(F.trim(model)) == name, F.lit(float(each))).otherwise(price)
    return F.floor(F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)) * price + 0.5).cast("long")


@query(f"SELECT event_type, count(*) AS n, max(epoch_us(ts)) AS mark_us FROM events WHERE epoch_us(ts) > epoch_us(TIMESTAMP '{MARK}') - {OVERLAP_US} AND ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def swept_events(spark, sf_dir):
    """What a sweep finds of each type, and its next mark."""
    at = micros(F.col("ts"))
    point = lambda t: micros(F.lit(t).cast("timestamp_ntz"))
    return sweep(table(spark, sf_dir, "events"), at, point(MARK), point(NOW)).groupBy("event_type").agg(F.count("*").alias("n"), F.max(at).alias("mark_us"))


@query(sql("invoices", f"SELECT 'overdue:' || invoice_id AS item_id, balance_pence FROM invoices WHERE balance_pence > 0 AND due_on < '{AS_OF}' AND invoice_id % 4 <> 0"))
def queued_once(spark, sf_dir):
    """Overdue bills that aren't in the queue yet; every fourth bill was queued before, and all are offered twice."""
    i = invoices(spark, sf_dir).withColumn("item_id", F.concat(F.lit("overdue:"), "invoice_id"))
    due = i.where((F.col("balance_pence") > 0) & (F.col("due_on") < AS_OF)).select("item_id", "balance_pence")
    return not_queued(due.unionByName(due), i.where("invoice_id % 4 = 0"), "item_id")


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'")
def stream_queued_once(spark, sf_dir):
    """The queue after two runs over the same events: each visit once."""
    at = work_folder(spark, "queue")
    items = events(spark, sf_dir, stream=True).where("event_type = 'view'").select("event_id", "user_id", F.to_date("at").alias("day"))
    for run in "ab":
        queue_stream(items, "event_id", f"{at}/out", f"{at}/checkpoint-{run}")
    return spark.read.schema(items.schema).parquet(f"{at}/out").select(*items.columns)


@query(sql("invoices", f"SELECT invoice_id, CASE WHEN balance_pence > 0 AND due_on < '{AS_OF}' THEN 'expired' WHEN balance_pence > 0 THEN 'active' ELSE 'used' END AS status, CASE WHEN balance_pence > 0 AND due_on < '{AS_OF}' THEN -balance_pence ELSE 0 END AS move_pence FROM invoices"))
def expiry_sweep(spark, sf_dir):
    """Cards with a balance after their last day expire, with a ledger move of what was left."""
    left = F.col("balance_pence") > 0
    gone = left & (F.col("due_on") < AS_OF)
    return invoices(spark, sf_dir).select("invoice_id", F.when(gone, "expired").when(left, "active").otherwise("used").alias("status"), F.when(gone, -F.col("balance_pence")).otherwise(0).alias("move_pence"))


def retained(rows: DataFrame, day: str, today: str, days: int) -> DataFrame:
    """Rows that a purge leaves: those of the last `days` days."""
    return rows.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


@query(sql("appts", "SELECT day, status, count(*) AS n FROM appts WHERE day >= DATE '2024-01-25' - 14 GROUP BY ALL"))
def retention(spark, sf_dir):
    return retained(appointments(spark, sf_dir), "day", "2024-01-25", 14).groupBy("day", "status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -1 - c_custkey, 0.0 FROM customer WHERE c_custkey % 50 = 0""")
def upserted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 50 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(new), "c_custkey")


@query("SELECT c_custkey, c_custkey % 4 + CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 2 THEN 1 ELSE 0 END AS rev, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 2 THEN 'new' ELSE c_mktsegment END AS note FROM customer")
def revision_updates(spark, sf_dir):
    """Changes that expect revision 2."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("rev"), F.col("c_mktsegment").alias("note"))
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(2).cast("long").alias("rev"), F.lit("new").alias("note"))
    return update_if(c, changes, "c_custkey", "rev", "note")


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_name DESC, s_suppkey LIMIT 5 OFFSET 3")
def page_with_total(spark, sf_dir):
    return page_at(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), [F.desc("s_name"), "s_suppkey"], 3, 5)


#: Calls that a month's price includes, its price, what a call more costs (pence), and micro-dollars a token by kind of model.
INCLUDED, PRICE_PENCE, EXTRA_PENCE, USD_GBP = 20, 3000, 50, 0.79
PRICES = {"view": 1.0, "click": 5.0}


@query(f"""WITH m AS (SELECT user_id AS tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS calls, CAST(sum(CAST(floor(floor(value) * CASE event_type WHEN 'view' THEN 1.0 ELSE 5.0 END + 0.5) AS BIGINT)) AS BIGINT) AS cost_micro FROM events GROUP BY 1, 2),
t AS (SELECT *, greatest(0, calls - {INCLUDED}) AS extra, tenant_id % 5 <> 0 AS paying FROM m),
r AS (SELECT *, CASE WHEN paying THEN {PRICE_PENCE} + {EXTRA_PENCE} * extra END AS revenue_pence FROM t)
SELECT CAST(tenant_id AS VARCHAR) AS tenant, month, calls, extra, cost_micro, revenue_pence, revenue_pence - CAST(floor(cost_micro * {USD_GBP} / 10000 + 0.5) AS BIGINT) AS margin_pence FROM r
UNION ALL SELECT 'total', month, CAST(sum(calls) AS BIGINT), CAST(sum(extra) AS BIGINT), CAST(sum(cost_micro) AS BIGINT), CAST(sum(revenue_pence) AS BIGINT), CAST(sum(revenue_pence - CAST(floor(cost_micro * {USD_GBP} / 10000 + 0.5) AS BIGINT)) AS BIGINT) FROM r GROUP BY month""")
def usage_margin(spark, sf_dir):
    """Calls, calls beyond those included, cost, revenue and margin of each tenant's month, and each month's total; tenants
    that don't pay have no revenue and stay out of the totals of money."""
    cost = token_cost(F.col("event_type"), F.floor("value"), PRICES)
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tenant_id"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost_micro"))
    r = m.withColumn("extra", F.greatest(F.lit(0), F.col("calls") - INCLUDED)).withColumn("revenue_pence", F.when(F.col("tenant_id") % 5 != 0, PRICE_PENCE + EXTRA_PENCE * F.col("extra")))
    r = r.withColumn("margin_pence", F.col("revenue_pence") - F.floor(F.col("cost_micro") * USD_GBP / 10000 + 0.5).cast("long"))
    sums = [F.sum(c).alias(c) for c in ("calls", "extra", "cost_micro", "revenue_pence", "margin_pence")]
    own = r.select(F.col("tenant_id").cast("string").alias("tenant"), "month", "calls", "extra", "cost_micro", "revenue_pence", "margin_pence")
    return own.unionByName(r.groupBy("month").agg(*sums).withColumn("tenant", F.lit("total")))


@query("""WITH c AS (SELECT user_id AS patient_id, CAST(ts AS DATE) AS done_on, event_id, event_type IN ('view', 'purchase') AS completed, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 11 END AS pain FROM events WHERE ts < DATE '2024-01-26')
SELECT patient_id, count(*) FILTER (done_on > DATE '2024-01-25' - 14) AS checkins, count(*) FILTER (done_on > DATE '2024-01-25' - 14 AND completed) AS completed, max(done_on) AS last_on,
arg_max(pain, event_id) FILTER (pain IS NOT NULL) AS latest_pain, CAST(floor(sum(pain) FILTER (done_on > DATE '2024-01-25' - 14) * 10.0 / count(pain) FILTER (done_on > DATE '2024-01-25' - 14) + 0.5) AS BIGINT) AS pain_tenths FROM c GROUP BY 1""")
def adherence(spark, sf_dir):
    """Check-ins of the last 14 days, those completed, the last day, the latest pain score and the mean in tenths. Event ids rise with time."""
    pain = F.when(F.col("event_type") != "error", F.floor("value").cast("long") % 11)
    c = table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-26 00:00:00").cast("timestamp_ntz")).select(F.col("user_id").alias("patient_id"), F.to_date("ts").alias("done_on"), "event_id", F.col("event_type").isin("view", "purchase").alias("done"), pain.alias("pain"))
    recent = F.col("done_on") > F.date_sub(F.lit("2024-01-25").cast("date"), 14)
    scored = F.when(recent, F.col("pain"))
    return c.groupBy("patient_id").agg(
        F.count_if(recent).alias("checkins"),
        F.count_if(recent & F.col("done")).alias("completed"),
        F.max("done_on").alias("last_on"),
        F.max_by("pain", F.when(F.col("pain").isNotNull(), F.col("event_id"))).alias("latest_pain"),
        F.floor(F.sum(scored) * 10 / F.count(scored) + 0.5).cast("long").alias("pain_tenths"),
    )
