"""CSV files that many tasks read, though cells hold line breaks.

A file is read as lines, by byte ranges as any text is. Whether a line begins inside quotes is the parity of the quotes before it: each range counts its
own, the counts of the ranges before are a running sum over one row a range, and the lines of a record are put together by its number.

Defined cases: lines end with \\n or \\r\\n; a byte-order mark is dropped; blank records are none; a quote that never ends makes one record of the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files in order, numbered from 1 in each file."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    ranges = Window.partitionBy("file").orderBy("block")
    before = lambda c: F.sum(c).over(ranges) - F.col(c)
    own = Window.partitionBy("file", "block").orderBy("at")
    parity = lines.groupBy("file", "block").agg(F.sum("quotes").alias("all")).select("file", "block", before("all").alias("ahead"))
    seen = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(parity, ["file", "block"]).withColumn("begins", ((F.col("ahead") + seen) % 2 == 0).cast("long"))
    counts = begun.groupBy("file", "block").agg(F.sum("begins").alias("n")).select("file", "block", before("n").alias("records"))
    numbered = begun.join(counts, ["file", "block"]).withColumn("record", F.col("records") + F.sum("begins").over(own))
    whole = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"))
    text = F.regexp_replace(F.array_join("l.value", "\n"), "\r$", "")
    return whole.select("file", "record", F.when(F.col("record") == 1, F.ltrim(text, F.lit("\ufeff"))).otherwise(text).alias("text")).where(F.trim("text") != "")
