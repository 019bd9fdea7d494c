"""Mixing sources to target weights.

Every source's words are packed, in the order of a hash bucket and then of doc_id, into blocks of a length that is fixed
for the source: BLOCK words, or less where the source is so small that a block would be a large part of it. For each output shard a multinomial
draw says how many blocks come from each source, among those that have blocks left; the running slot number of a source goes through that source's own
pseudorandom permutation of block numbers, and slots meet blocks in a join by (source, block). Draws decide in which shard
words stand; a source's total is its number of slots whatever is drawn.

Defined cases: null text has no words; null source is a source of its own, last in order; equal rows are documents of
their own; an empty table gives an empty result; a source without words has target 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm._util import Workspace, buckets, free_name, mix64, n_words, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
#: Blocks that a small source is cut into at least, as far as it has words.
LEAST_BLOCKS = 256
SHARD_BLOCKS = 65_536
#: Output shards that are drawn together, in one task.
GROUP_SHARDS = 1024
#: Parts of a source whose documents are put in order apart, at least, and documents for each; they follow from the number of
#: documents alone, so that the mix does not depend on the cluster.
BUCKETS = 1024
BUCKET_ROWS = 20_000
SEED = 20_240_601


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Keyed permutation of 0..n-1, elementwise: a Feistel network on the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (mix64(right + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source_key, source_size): rank, target, block length, blocks and slots of each source. One row per source,
    so its windows hold as many rows as there are sources.

    target = min(2 * size, level * weight), with the level at which targets add up to 150% of all words.
    """
    by_source = Window.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_source)).withColumn("weight", weight)
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    below, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("used", F.coalesce(F.sum(F.col("source_size") * MOST).over(below), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("at", (F.col("total") * SHARE - F.col("used")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("at") * F.col("weight") <= F.col("source_size") * MOST, F.struct(F.col("source_size") / F.col("weight"), "rank", "at"))).over(every)["at"])
    )
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(MOST)))).otherwise(0)
    return (
        level.withColumn("target", F.least(F.col("source_size") * MOST, F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * MOST)))
        .withColumn("block_words", F.greatest(F.least(F.lit(BLOCK).cast("long"), F.ceil(F.col("source_size") / LEAST_BLOCKS)), F.lit(1)))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
        .withColumn("passes", passes)
        .withColumn("rest", F.round((F.col("target") - F.col("passes") * F.col("source_size")) / F.col("block_words")).cast("long"))
        .withColumn("slots", F.least(F.col("passes") * F.col("blocks") + F.least("rest", "blocks"), F.col("blocks") * int(MOST)).cast("long"))
        .select("source_key", "source_size", F.col("rank").cast("int").alias("source_id"), "target", "block_words", "blocks", "slots")
    )


def _drawn(rng: np.random.Generator, size: int, left: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A multinomial draw of `size` blocks by the shares. What falls on a source beyond the blocks it has left is drawn again among the others."""
    counts = np.zeros(len(left), np.int64)
    while (todo := size - int(counts.sum())) > 0:
        p = np.where(counts < left, share, 0.0)
        counts = np.minimum(counts + rng.multinomial(todo, p / p.sum()), left)
    return counts


def shard_counts(targets: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """(shard, source_id, blocks, start, drawn): how many blocks each output shard takes of each source, and from which of its slots on.

    Shards are drawn one after the other, and so are groups of shards before them, so that one group's shards can be drawn
    apart from another's. The last group and the last shard of a group take what is left, so every source gives exactly its slots.
    """
    plan = targets.where("slots > 0").agg(F.array_sort(F.collect_list(F.struct("source_id", "blocks", "slots"))).alias("plan"))

    def draw(whole: np.ndarray, start: np.ndarray, size: int, level: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        share, left = whole / max(whole.sum(), 1), whole.copy()
        for k in range(-(-int(whole.sum()) // size)):
            counts = _drawn(np.random.default_rng([seed, *level, k]), min(size, int(left.sum())), left, share)
            yield k, start, counts
            start, left = start + counts, left - counts

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, blocks, slots = (np.array([x[c] for x in row["plan"]], np.int64) for c in ("source_id", "blocks", "slots"))
                for k, start, counts in draw(slots, np.zeros_like(slots), shard_blocks * group_shards, []):
                    yield pa.RecordBatch.from_pydict({"g": pa.array([k], pa.int32()), **{c: pa.array([x], pa.list_(pa.int64())) for c, x in (("ids", ids), ("blocks", blocks), ("start", start), ("counts", counts))}})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, blocks, first, whole = (np.array(row[c], np.int64) for c in ("ids", "blocks", "start", "counts"))
                for k, start, counts in draw(whole, first, shard_blocks, [row["g"]]):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(ids), row["g"] * group_shards + k, np.int32)), "source_id": pa.array(ids.astype(np.int32)), "blocks": pa.array(blocks), "start": pa.array(start), "drawn": pa.array(counts)})

    long = "array<bigint>"
    dealt = plan.mapInArrow(groups, f"g int, ids {long}, blocks {long}, start {long}, counts {long}").repartition(buckets(targets.sparkSession), "g")
    return dealt.mapInArrow(inside, "shard int, source_id int, blocks long, start long, drawn long")


def slot_table(targets: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source_id, block, shard, turn, slot, epoch): which block each slot of a source holds, and where it goes: turn orders the blocks of a shard."""
    step = 1 << 16
    upto = F.col("start") + F.col("drawn")
    runs = shard_counts(targets, seed, shard_blocks).where("drawn > 0").withColumn("from", F.explode(F.sequence("start", upto - 1, F.lit(step).cast("long")))).select("source_id", "blocks", "shard", F.col("from").alias("start"), F.least(F.col("from") + step, upto).alias("stop"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["start"], r["stop"], dtype=np.int64)
                n = np.full(len(slot), r["blocks"], np.int64)
                key = np.full(len(slot), seed * 1_000_003 + r["source_id"], np.uint64)
                turn = (mix64(key ^ mix64(slot)) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"source_id": pa.array(np.full(len(slot), r["source_id"], np.int32)), "block": pa.array(permuted(slot % n, n, key)), "shard": pa.array(np.full(len(slot), r["shard"], np.int32)), "turn": pa.array(turn), "slot": pa.array(slot), "epoch": pa.array((slot // n).astype(np.int32))})

    return runs.repartition(buckets(targets.sparkSession)).mapInArrow(fill, "source_id int, block long, shard int, turn long, slot long, epoch int")


def sized(docs: DataFrame, space: Workspace, name: str = "sized") -> DataFrame:
    """(row_key, doc_id, source, source_key, size), saved: one row per document, whose key never changes again."""
    return space.save(_keyed_sizes(docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "source", n_words(F.col("text")).alias("size"))), name)


def _keyed_sizes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row_key",
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
        "size",
    )


def offsets(rows: DataFrame) -> DataFrame:
    """Adds `start`: the words of a source before each document, by bucket and then doc_id. No task holds a whole source."""
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "size"), F.lit(max(BUCKETS, -(-n // BUCKET_ROWS)))).cast("int"))
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source_key").orderBy("bucket")
    base = sums.select("source_key", "bucket", (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("size").over(inside)).join(base, ["source_key", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("base", "upto")


def block_pieces(placed: DataFrame) -> DataFrame:
    """One row per document and block it lies in: words [at, at + n) of the document, which begin at word `into` of the block."""
    first, last = F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    ahead = F.col("block") * F.col("block_words") - F.col("start")
    at = F.greatest(ahead, F.lit(0))
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select("row_key", "doc_id", "source_id", "block", at.alias("at"), (F.least((F.col("block") + 1) * F.col("block_words") - F.col("start"), F.col("size")) - at).alias("n"), F.greatest(-ahead, F.lit(0)).alias("into"))
    )


def _placed(rows: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and the sized rows with the place of each in its source."""
    targets = space.save(source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))), "targets")
    return targets, offsets(rows).join(targets.select("source_key", "source_id", "block_words"), "source_key")


def mix(docs: DataFrame, space: Workspace, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, targets, mixed pieces). A mixed piece is part of a block in an output slot:
    row_key, doc_id, source_id, block, at, n, into, shard, turn, slot, epoch."""
    rows = sized(docs, space)
    targets, placed = _placed(rows, space)
    # the planner takes a table made in Python for as small as what it was made from, and would broadcast the slots
    return rows, targets, block_pieces(placed).join(slot_table(targets, seed, shard_blocks).hint("merge"), ["source_id", "block"])


def mix_summary(docs: DataFrame, space: Workspace, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last output shard that hold words of it, one row per document."""
    rows, targets, mixed = mix(docs, space, seed, shard_blocks)
    taken = mixed.groupBy("row_key").agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return (
        rows.join(targets.select("source_key", "source_size", "target"), "source_key")
        .join(taken, "row_key", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")
    )


def _keyed(docs: DataFrame, key: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The documents with a key for each row, saved, and their sizes under that key."""
    keyed = space.save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    return keyed, space.save(_keyed_sizes(keyed.select(F.col(key).alias("row_key"), "doc_id", "source", n_words(F.col("text")).alias("size"))), "sized")


def mixed_blocks(docs: DataFrame, space: Workspace, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix as blocks of words: shard, turn (its order in the shard), source_id, slot, doc_ids, text. Sorted by shard and turn."""
    keyed, rows = _keyed(docs.select("doc_id", "source", "text"), "row_key", space)
    targets, placed = _placed(rows, space)
    w = words(F.col("text"))
    parts = block_pieces(placed).join(keyed.select("row_key", "text"), "row_key").select("source_id", "block", "into", "doc_id", F.slice(w, (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("w"))
    whole = parts.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("into", "doc_id", "w"))).alias("p"))
    texts = whole.select("source_id", "block", F.col("p.doc_id").alias("doc_ids"), F.array_join(F.flatten("p.w"), " ").alias("text"))
    mixed = texts.join(slot_table(targets, seed, shard_blocks).hint("merge"), ["source_id", "block"])
    return mixed.select("shard", "turn", "source_id", "slot", "doc_ids", "text").repartitionByRange("shard", "turn").sortWithinPartitions("shard", "turn")


def mixed_documents(docs: DataFrame, space: Workspace, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS, places: bool = False) -> DataFrame:
    """The mix as documents: one row per document and pass over its source that takes words of it, with those words in order.

    A row stands where the first of its blocks in the mix stands: rows are sorted by that block's shard and turn, which are given as
    columns if `places`. A document taken whole keeps its text; of others the taken words are joined by one blank. n_chars, where the table has
    it, is the new text's; all other columns are kept.
    """
    key, place = free_name(docs, "row_key"), free_name(docs, "place")
    keyed, rows = _keyed(docs, key, space)
    targets, placed = _placed(rows, space)
    mixed = block_pieces(placed).join(slot_table(targets, seed, shard_blocks).hint("merge"), ["source_id", "block"])
    spans = mixed.groupBy("row_key", "epoch").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("spans"), F.sum("n").alias("taken"), F.min(F.struct("shard", "turn")).alias("place"))
    plan = spans.join(rows.select("row_key", "size"), "row_key").select(F.col("row_key").alias(key), F.col("place").alias(place), F.struct(F.when(F.col("taken") < F.col("size"), F.col("spans")).alias("spans")).alias("_plan" + key))
    ordered = keyed.join(plan, key).repartitionByRange(F.col(place)["shard"], F.col(place)["turn"]).sortWithinPartitions(F.col(place)["shard"], F.col(place)["turn"])
    parts = F.col("_plan" + key)["spans"]
    text = F.when(parts.isNull(), F.col("text")).otherwise(_spans_text(F.col("text"), parts))
    own = [F.col(place)["shard"].alias(free_name(docs, "shard")), F.col(place)["turn"].alias(free_name(docs, "turn"))] if places else []
    out = ordered.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns], *own)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _spans_text(text, spans):
    return F.transform(F.array(words(text)), lambda w: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["n"].cast("int")))), " "))[0]
