"""Steps that go on after a stop: paged imports on a checkpoint, loads with an audit row, sweeps whose mark is stored, and
receipts that meet what was sent, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.errors.exceptions.captured import SparkRuntimeException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from wardflow.registry import query
from wardflow.sources.tables import NOW, table
from wardflow.streaming.jobs import events, run_to_end, shared_folder, work_folder


def run_steps(spark: SparkSession, source: str, schema, step: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, files_a_page: int = 1) -> None:
    """Runs `step` over the files of a folder, a page of them at a time. Each page's result is a folder of its own that a
    repeated page replaces, and the checkpoint holds how far it came: after a stop the same call goes on, and no page is
    lost or counted twice."""

    def page(batch: DataFrame, n: int) -> None:
        step(batch, n).write.mode("overwrite").parquet(f"{out}/page={n}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_page).parquet(source)
    rows.writeStream.foreachBatch(page).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("SELECT status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'error' WHEN o_orderkey % 10 = 0 THEN 'warning' ELSE 'ready' END AS status FROM orders) GROUP BY 1")
def restarted_steps(spark, sf_dir):
    """A check of rows in pages that stops in the third page and is started again; the outcome is as if it had not stopped."""
    at = work_folder(spark, "steps")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rows.repartition(6, "o_orderkey").write.parquet(f"{at}/staged")
    stops = [2]

    def check(batch: DataFrame, n: int) -> DataFrame:
        if n in stops:
            stops.remove(n)
            raise RuntimeError("stopped on purpose")
        return batch.select("o_orderkey", F.when(F.col("o_totalprice") < 50_000, "error").when(F.col("o_orderkey") % 10 == 0, "warning").otherwise("ready").alias("status"))

    for _ in range(2):
        try:
            run_steps(spark, f"{at}/staged", rows.schema, check, f"{at}/out", f"{at}/checkpoint")
        except StreamingQueryException:
            continue
    done = spark.read.schema("o_orderkey long, status string, page int").parquet(f"{at}/out")
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def bulk_load(rows: DataFrame, path: str, audit: str, action: str, key: str) -> None:
    """Adds a load to a table and one row on it to its audit table: action, how many, least and largest key, counted on
    what was written. A load is a folder of its own that a repeated load of the same action replaces, and so is its audit row, which comes
    last: a load without one isn't complete, and `loaded` leaves it out."""
    spark, at = rows.sparkSession, f"action={quote(action, safe='')}"
    rows.write.mode("overwrite").parquet(f"{path}/{at}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{at}")
    written.agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).coalesce(1).write.mode("overwrite").parquet(f"{audit}/{at}")


def audits(spark: SparkSession, audit: str, key_type: str) -> DataFrame:
    """The audit rows of all complete loads."""
    return spark.read.schema(f"action string, n long, first_key {key_type}, last_key {key_type}").parquet(audit).select("action", "n", "first_key", "last_key")


def loaded(spark: SparkSession, path: str, audit: str, schema, key_type: str) -> DataFrame:
    """The rows of all complete loads, with their action."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("action", StringType())])).parquet(path)
    return rows.join(audits(spark, audit, key_type).select("action"), "action", "left_semi")


@query("SELECT 'load ' || k AS action, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key, (SELECT count(*) FROM part) AS total FROM (SELECT p_partkey, p_partkey % 3 AS k FROM part) GROUP BY k")
def bulk_loads(spark, sf_dir):
    """Three loads into one table, an audit row for each, and the rows that the table holds after all."""
    at = work_folder(spark, "loads")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    for k in range(3):
        bulk_load(p.where(F.col("p_partkey") % 3 == k), f"{at}/rows", f"{at}/audit", f"load {k}", "p_partkey")
    kind = p.schema["p_partkey"].dataType.simpleString()
    total = loaded(spark, f"{at}/rows", f"{at}/audit", p.schema, kind).agg(F.count("*").alias("total"))
    return audits(spark, f"{at}/audit", kind).join(F.broadcast(total), F.lit(True))


class SweepStore:
    """Sweeps over rows that change, with a stored mark: results and mark of a sweep are one commit.

    A sweep takes the rows written since the mark less the overlap, up to now, and writes what `consume` makes of them to a folder of its own
    number; the mark's row follows in a folder of the same number. A sweep that stops before that has no mark: its rows
    count for nothing, and the next sweep has the same number, starts from the same mark and replaces them. No row is lost or counted twice.
    """

    def __init__(self, spark: SparkSession, path: str, overlap: str = "2 hours"):
        self.spark, self.path, self.overlap = spark, path, overlap

    def marks(self) -> DataFrame:
        """(sweep, mark) of the sweeps that came to their end."""
        self.spark.createDataFrame([], "mark timestamp").write.mode("ignore").parquet(f"{self.path}/marks/sweep=-1")
        return self.spark.read.schema("mark timestamp, sweep int").parquet(f"{self.path}/marks").where("mark IS NOT NULL")

    def results(self, schema) -> DataFrame:
        """What the sweeps that came to their end have written, with their number."""
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("sweep", IntegerType())])).parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(self.marks().select("sweep")), "sweep", "left_semi")  # one number for each sweep

    def run(self, rows: DataFrame, at: str, now: str, consume: Callable[[DataFrame], DataFrame], seen: tuple[str, ...] = (), most: int | None = None) -> None:
        """One sweep. seen: columns of the results, and of the rows, that tell a row taken by an earlier sweep, which is left out; without
        them rows in the overlap come again. most: that many rows at once, the earliest; the mark then moves as far as they reach."""
        last = self.marks().agg(F.max("mark").alias("mark"), F.max("sweep").alias("sweep")).first()
        number = 0 if last.sweep is None else last.sweep + 1
        upto = F.lit(now).cast("timestamp")
        found = rows.where(F.col(at) <= upto)
        if last.mark is not None:
            found = found.where(F.col(at) > F.lit(last.mark) - F.expr(f"INTERVAL {self.overlap}"))
            if seen:
                kinds = StructType([rows.schema[c] for c in seen])
                # what the overlap can show again was taken by sweeps whose marks lie in it, or the one before
                recent = [r[0] for r in self.marks().where(F.col("mark") > F.lit(last.mark) - F.expr(f"INTERVAL {self.overlap}")).select("sweep").collect()]
                found = found.join(self.results(kinds).where(F.col("sweep").isin(recent)).select(*seen), list(seen), "left_anti")
        mark = upto
        if most is not None:
            found = found.orderBy(at, *seen).limit(most)
            reached = found.agg(F.count("*").alias("n"), F.max(at).alias("at")).first()
            if reached.n == most:
                mark = F.lit(reached.at).cast("timestamp")
                found = found.where(F.col(at) <= mark)
        consume(found).write.mode("overwrite").parquet(f"{self.path}/rows/sweep={number}")
        self.spark.range(1).select(mark.alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/sweep={number}")


_SWEEPS = ("2024-01-10 00:00:00", "2024-01-15 06:00:00", "2024-01-15 07:00:00", NOW)


@query(" UNION ALL ".join(f"SELECT {k} AS sweep, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts <= TIMESTAMP '{now}'" + (f" AND ts > TIMESTAMP '{_SWEEPS[k - 1]}' - INTERVAL 2 HOUR" if k else "") for k, now in enumerate(_SWEEPS)))
def stored_sweeps(spark, sf_dir):
    """Four sweeps one after the other; each looks two hours behind the mark that the one before stored."""
    store, e = SweepStore(spark, work_folder(spark, "sweeps")), events(spark, sf_dir)
    for now in _SWEEPS:
        store.run(e, "at", now, lambda rows: rows.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))
    return store.results(StructType([StructField("n", LongType()), StructField("ids", LongType())]))


@query(f"SELECT CASE WHEN ts <= TIMESTAMP '{_SWEEPS[0]}' THEN 0 WHEN ts <= TIMESTAMP '{_SWEEPS[1]}' THEN 1 ELSE 2 END AS sweep, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def swept_once(spark, sf_dir):
    """Sweeps that take each event once; the second one stops before it has written all, and is run again."""
    store, e = SweepStore(spark, work_folder(spark, "sweeps")), events(spark, sf_dir)
    take = lambda rows: rows.select("event_id")
    store.run(e, "at", _SWEEPS[0], take, ("event_id",))
    try:
        store.run(e, "at", _SWEEPS[1], lambda rows: take(rows).where(F.raise_error("stopped on purpose").isNull()), ("event_id",))
    except SparkRuntimeException:
        pass  # what it wrote has no mark
    for now in (_SWEEPS[1], NOW):
        store.run(e, "at", now, take, ("event_id",))
    done = store.results(StructType([e.schema["event_id"]]))
    return done.groupBy("sweep").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def receipts(sent: DataFrame, got: DataFrame, minutes: int = 30) -> DataFrame:
    """(message_id, receipt_id): receipts of the same person within a time of the message. Both sides carry `at`; as streams
    both need a watermark, and state goes when the time has passed. They meet in slots of that length, so that a person
    with many messages is many keys: a message stands in its own slot and the next, a receipt in its own."""
    slot = lambda at: F.floor(F.unix_seconds(at) / (60 * minutes))
    a = sent.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("who"), F.col("at").alias("sent_at"), F.explode(F.array(slot(F.col("at")), slot(F.col("at")) + 1)).alias("sent_slot"))
    b = got.select(F.col("event_id").alias("receipt_id"), "user_id", F.col("at").alias("got_at"), slot(F.col("at")).alias("got_slot"))
    return a.join(b, F.expr(f"who = user_id AND sent_slot = got_slot AND got_at >= sent_at AND got_at <= sent_at + INTERVAL {minutes} MINUTES")).select("message_id", "receipt_id")


@query("SELECT a.event_id AS message_id, b.event_id AS receipt_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def message_receipts(spark, sf_dir):
    """Purchases stand for messages, views for receipts."""
    e = events(spark, sf_dir)
    return receipts(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"))


@query("SELECT a.event_id AS message_id, b.event_id AS receipt_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def stream_message_receipts(spark, sf_dir):
    """The same as a join of two streams."""
    e = events(spark, sf_dir, stream=True).withWatermark("at", "2 hours")
    return run_to_end(receipts(e.where("event_type = 'purchase'"), e.where("event_type = 'view'")), shared_folder(spark))
