"""Similarity join of sets of words: prefix filtering, with sieves where sets meet, and an exact check of what passes.

Two sets alike to the threshold share one of their rarest words, so only those few words of each set are sent. Sets that meet on a word
are sieved in the task that holds it, first by what follows that word in both: at their first common word alike sets have as many words left as they
must share. A set's bitmap has the parity of its words under each of so many bits, two bitmaps differ in no more bits than the
sets in words, and alike sets differ in (1 - t) / (1 + t) of their words at most. So no pair is lost, and unlike sets, whose number grows
with the square of the input, are neither sent nor stored. Sets that also share one of the few words just before meet on that one too, so a pair comes from few of its words.

What passes is checked by cells: sets that met are dealt to cells of about `CELL` sets around the least id that they met, and two cells that hold a pair
are compared whole in one task. So a set of a crowd of m near copies is sent m / CELL times and not m times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets that hold a word before it counts as common, and the most common words that are told apart by their number; the order decides the cost only.
COMMON = 4
MOST_COMMON = 1_000_000
#: Words of 64 bits of a bitmap, by the size of its set: so many that unlike sets differ in some four deviations more bits than alike ones may.
WIDTHS = ((40, 1), (180, 2), (430, 4), (950, 8), (2000, 16))
WIDEST = 32
#: Ids up to which a table of them is broadcast.
NARROW = 2_000_000
#: Words before a word of a prefix that are sent with it, rows that are sieved at once, and pairs after which they leave.
BEFORE = 2
ROWS = 100_000
PAIRS = 1_000_000
#: Sets of a cell, and words of cells that are counted at once.
CELL = 128
COUNTED = 4096


def parity(h: np.ndarray) -> bytes:
    """The bitmap of a set of word hashes. Its halves, added bit by bit, are the bitmap of half the width."""
    width = next((k for most, k in WIDTHS if len(h) <= most), WIDEST)
    at = (h.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * width)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * width) & 1, bitorder="little").astype(np.uint8).tobytes()


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of 64-bit numbers."""
    size = rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of 64-bit numbers, filled up to a width with zeros, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    at, many = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
    out = np.zeros((len(column), width), np.uint64)
    for k in np.unique(many).tolist():
        of = np.flatnonzero(many == k)
        out[of, :k] = data[at[of, None] + np.arange(k)]
    return out, many.astype(np.int64)


def _entries(common, threshold: float):
    """From rows (id, h): a row (x, id, n, at, before, bits) for each word x of a set's prefix, with its place and the words before it, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common.value
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            h, n = batch.column("h").flatten().to_numpy(), batch.column("h").value_lengths().fill_null(0).to_numpy().astype(np.int64)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, count[at], 0)
            of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            bits = pa.array([parity(h[lo : lo + k]) for lo, k in zip(first.tolist(), n.tolist())], pa.binary())
            h = h[np.lexsort((h, rank, of))]
            place = np.arange(len(h)) - first[of]
            sent = np.flatnonzero(place < (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)[of])
            before = np.stack([np.where(place[sent] >= k, h[np.maximum(sent - k, 0)], 0) for k in range(1, BEFORE + 1)], 1)
            of = of[sent]
            yield pa.RecordBatch.from_arrays([pa.array(h[sent]), batch.column("id").take(pa.array(of)), pa.array(n[of]), pa.array(place[sent]), _binary(before), bits.take(pa.array(of))], ["x", "id", "n", "at", "before", "bits"])

    return run


def _differ(bits: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of rows i and j differ, at the smaller one's width."""
    out, kind = np.zeros(len(i), np.int64), width[i] * (WIDEST + 1) + width[j]
    for a, b in (divmod(k, WIDEST + 1) for k in np.flatnonzero(np.bincount(kind)).tolist()):
        of = np.flatnonzero(kind == a * (WIDEST + 1) + b)
        x, y = bits[i[of], :a], bits[j[of], :b]
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[of] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _met(threshold: float):
    """From rows (x, id, n, at, before, bits) in the order of x, n: pairs (a, b) of sets that may be alike, some of them more than once.
    Without at and before, the word is the first of its sets."""
    apart, shared = (1 - threshold) / (1 + threshold), threshold / (1 + threshold)

    def pairs(x, ids, n, left, before, bits, width) -> Iterator[pa.RecordBatch]:
        found, held, d = [], 0, 1
        at = np.flatnonzero(left >= 2 * shared * n - 1e-6)  # the smaller set of a pair must share at least so many words
        while len(at):  # each row with the d-th after it, as long as that has its word and isn't too large
            at = at[at + d < len(x)]
            at = at[(x[at + d] == x[at]) & (n[at] >= n[at + d] * threshold - 1e-9)]
            for lo in range(0, len(at), ROWS):
                i = at[lo : lo + ROWS]
                least = (n[i] + n[i + d]) * shared - 1e-6
                i = i[(left[i] >= least) & (left[i + d] >= least) & ((before[i, 0] != before[i + d, 0]) | (before[i, 0] == 0))]
                i = i[_differ(bits, width, i, i + d) <= (n[i] + n[i + d]) * apart + 1e-6]
                again = np.zeros(len(i), bool)
                for k in range(BEFORE):
                    again |= ((before[i] == before[i + d, k][:, None]) & (before[i] != 0)).any(axis=1)
                i = i[~again]
                i = i[ids[i] != ids[i + d]]
                if len(i):
                    found.append((np.minimum(ids[i], ids[i + d]), np.maximum(ids[i], ids[i + d])))
                    held += len(i)
                if held >= PAIRS:
                    yield batch_of(found)
                    found, held = [], 0
            d += 1
        yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def columns(batch: pa.RecordBatch) -> tuple:
        x, ids, n = (batch.column(c).to_numpy() for c in ("x", "id", "n"))
        placed = "at" in batch.schema.names
        left = n - batch.column("at").to_numpy() if placed else n
        before = _numbers(batch.column("before"), BEFORE)[0] if placed else np.zeros((len(x), BEFORE), np.uint64)
        return (x, ids, n, left, before, *_numbers(batch.column("bits"), WIDEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append(columns(batch))
            rows += batch.num_rows
            if rows < ROWS:
                continue
            whole = [np.concatenate(c) for c in zip(*parts)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            if last:
                yield from pairs(*(c[:last] for c in whole))
            parts, rows = [tuple(c[last:] for c in whole)], 0
        if parts:
            yield from pairs(*(np.concatenate(c) for c in zip(*parts)))

    return run


def _alike(threshold: float):
    """From the sets (first, id, w) of two cells, or of one: its pairs (a, b, common, jaccard) that are alike, each once."""

    def run(sets: pa.Table) -> pa.Table:
        first, ids, w = (sets[c].combine_chunks() for c in ("first", "id", "w"))
        first, ids, n = first.to_numpy(zero_copy_only=False), ids.to_numpy(), w.value_lengths().to_numpy().astype(np.int64)
        word, row = w.flatten().dictionary_encode().indices.to_numpy(), np.repeat(np.arange(len(n)), n)
        often = np.bincount(word) > 1  # words of one set only are common to no two
        number = np.cumsum(often) - 1
        row, word = row[often[word]], number[word[often[word]]]
        order = np.argsort(word, kind="stable")
        row, word = row[order], word[order]
        x, y = np.flatnonzero(first), np.flatnonzero(~first)
        one = not len(y)  # pairs within a cell
        y = x if one else y
        common = np.zeros((len(x), len(y)), np.int64)
        for lo in range(0, int(often.sum()), COUNTED):
            of = slice(*np.searchsorted(word, (lo, lo + COUNTED)))
            has = np.zeros((len(n), min(COUNTED, int(word[-1]) + 1 - lo)), np.float32)
            has[row[of], word[of] - lo] = 1
            common += np.rint(has[x] @ has[y].T).astype(np.int64)
        jaccard = common / np.maximum(n[x][:, None] + n[y][None, :] - common, 1)
        i, j = np.nonzero((jaccard >= threshold - 1e-9) & (ids[x][:, None] != ids[y][None, :]))
        if one:
            i, j = i[i < j], j[i < j]
        a, b = ids[x[i]], ids[y[j]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "common": common[i, j], "jaccard": jaccard[i, j]})

    return run


def near_pairs(keyed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, common, jaccard), a < b, of rows (id: long, w: distinct words in order, without line breaks) alike to the threshold. Equal sets are
    one class, named by its least id; they meet by their digests, so that sets aren't shuffled for it. No pair is lost."""
    from wardflow.streaming.jobs import work_folder

    spark = keyed.sparkSession
    save = lambda df, name: (df.write.option("compression", "zstd").parquet(at := work_folder(spark, name)), spark.read.schema(df.schema).parquet(at))[1]
    sets = keyed.where("id IS NOT NULL").select("id", "w", F.unhex(F.sha2(F.array_join("w", "\n"), 256)).alias("digest"), F.monotonically_increasing_id().alias("nth"))
    sets = save(sets, "sets")
    twins = sets.groupBy("digest").agg(F.min(F.struct("id", "nth")).alias("least"), F.count("*").alias("copies")).where("copies > 1").select("digest", "least")
    few = twins.limit(NARROW + 1).count() <= NARROW
    keyed = sets.join(F.broadcast(twins) if few else twins, "digest", "left").where("least IS NULL OR nth = least.nth").select("id", "w")
    keyed = keyed if few else save(keyed, "classes")
    hashed = keyed.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    often = hashed.select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = often["h"].to_numpy(), often["count"].to_numpy()
    order = np.argsort(h)
    common = spark.sparkContext.broadcast((h[order], n[order]))
    entries = hashed.mapInArrow(_entries(common, threshold), "x long, id long, n long, at long, before binary, bits binary")
    # the work is in the pairs that meet and not in the bytes that are shuffled, hence a set number of tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = save(entries.repartition(tasks, "x").sortWithinPartitions("x", "n").mapInArrow(_met(threshold), "a long, b long"), "met")
    lead = met.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))).groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("lead"))
    crowds = lead.groupBy("lead").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    cells = save(lead.join(crowds, "lead").select("id", F.struct("lead", F.pmod(F.xxhash64("id"), "cells").alias("nth")).alias("cell")), "cells")
    if cells.limit(NARROW + 1).count() <= NARROW:
        cells = F.broadcast(cells)
    of = lambda c: cells.select(F.col("id").alias(c), F.col("cell").alias(f"cell_{c}"))
    two = met.join(of("a"), "a").join(of("b"), "b").select(F.least("cell_a", "cell_b").alias("x"), F.greatest("cell_a", "cell_b").alias("y")).distinct()
    sent = save(two.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("cell")).join(cells, "cell").select("x", "y", (F.col("cell") == F.col("x")).alias("first"), "id"), "sent")
    sent = keyed.join(cells.select("id"), "id", "left_semi").join(F.broadcast(sent) if sent.limit(NARROW // 4 + 1).count() <= NARROW // 4 else sent, "id")
    return sent.groupBy("x", "y").applyInArrow(_alike(threshold), "a long, b long, common long, jaccard double")
