"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their distinct five-word shingles, [1,2) [2,4) [4,8) ...; the bottom-k sketch
of a partition has k = 2 * floor(slack * upper) + 2 minimum hashes, slack = 1 - threshold. A document that holds at
least the threshold of an item's n shingles lacks at most floor(slack * n) of them, so it holds at least
k - floor(slack * n) of the sketch: the candidate test loses no pair, whatever the length of the document.
Candidates are then verified on the shingle strings themselves.

Words are runs of letters and digits, lower case. Defined cases: a text under five words is one shingle of all its
words; a text without words has no shingle and matches nothing; null ids are ids of their own; equal rows and equal
ids are reported once, with the largest containment; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import free_name

WORDS = 5
THRESHOLD = 0.8
#: Rows (16 bytes each) of sketches, and of candidates, up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.least(F.size(w), F.lit(1))))


def shingle_hashes(w: Column) -> Column:
    """One hash for each shingle of the words, repeats included."""
    return F.transform(_starts(w), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(F.transform(_starts(w), lambda x, i: F.array_join(F.slice(w, i + 1, WORDS), " ")))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, n (distinct shingles), need (sketch hashes a match must hold), hash: one row for each sketch hash."""
    slack = F.lit(1 - threshold + 1e-9)
    hashed = items.select("item_id", plain_words(F.col("text")).alias("w")).select("item_id", F.sort_array(F.array_distinct(shingle_hashes(F.col("w")))).alias("h")).where(F.size("h") > 0)
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.size("h").cast("double"))) + 1) - 1
    k = F.least(2 * F.floor(upper * slack) + 2, F.size("h").cast("long")).cast("int")
    return hashed.select("item_id", F.size("h").alias("n"), k.alias("k"), "h").select("item_id", "n", F.greatest(F.col("k") - F.floor(F.col("n") * slack), F.lit(1)).alias("need"), F.explode(F.slice("h", F.lit(1), F.col("k"))).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_shingles, found, containment: pairs with containment of at least the threshold."""
    sketches = item_sketches(items, threshold)
    if sketches.count() <= BROADCAST_ROWS:
        sketches = F.broadcast(sketches)
    hashes = docs.select("doc_id", plain_words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes(F.col("w"))).alias("hash"))
    candidates = hashes.join(sketches, "hash").groupBy("doc_id", "item_id").agg(F.countDistinct("hash").alias("hits"), F.min("need").alias("need")).where(F.col("hits") >= F.col("need")).select(F.col("doc_id").alias("at_doc"), F.col("item_id").alias("at_item"))
    # few documents have a candidate: their ids go to the texts, and only beyond the bound the texts to the ids
    candidates = candidates.persist()
    if candidates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    texts = docs.select("doc_id", "text").join(candidates, F.col("doc_id").eqNullSafe(F.col("at_doc"))).select("doc_id", "at_item", plain_words(F.col("text")).alias("dw"))
    wanted = items.select("item_id", plain_words(F.col("text")).alias("iw")).select("item_id", shingle_texts(F.col("iw")).alias("want"))
    return (
        texts.join(wanted, F.col("item_id").eqNullSafe(F.col("at_item")))
        .select("doc_id", "item_id", F.size("want").cast("long").alias("item_shingles"), F.size(F.array_intersect("want", shingle_texts(F.col("dw")))).cast("long").alias("found"))
        .withColumn("containment", F.col("found") / F.col("item_shingles"))
        .where(F.col("found") >= F.col("item_shingles") * F.lit(threshold) - 1e-9)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("item_shingles", "found"), "containment").alias("m"), F.max("containment").alias("containment"))
        .select("doc_id", "item_id", "m.item_shingles", "m.found", "containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item."""
    bad_doc = free_name(docs, "bad_doc")
    bad = contaminated(docs, items, threshold).select(F.col("doc_id").alias(bad_doc)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_doc)), "left_anti")


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS found, count(*) / item_shingles::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= item_shingles * {THRESHOLD}::DOUBLE - 1e-9
"""
