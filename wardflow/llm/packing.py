"""Best-two-fit packing of documents into sequences of SEQUENCE tokens.

Documents are tokenised where they lie; a longer one is cut so that only its first piece is shorter than a sequence. Pieces are
dealt by a hash of their row to shards of about SHARD_PIECES, whose number follows from the number of pieces alone, and
each shard is packed by itself: a bin opens with the largest piece left and is filled greedily with the largest that still
fits; then, while there is a gap, the bin's smallest piece is replaced by the two unpacked pieces that fill the widened gap best,
if they fill it better. Only lengths decide, so a shard's state is a count for each length and a set of lengths in one integer.
A shard wastes at most what its last bins waste, one part in thousands.

Defined cases: a null or empty text has the end id alone; null and repeated doc_ids are documents of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace
from wardflow.llm._util import pieces as slices
from wardflow.llm.token_ids import FILE_TEXT, encoder_of

SEQUENCE = 2048
#: Pieces that one task packs by themselves.
SHARD_PIECES = 100_000


def cut(counts: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of so many tokens: document, piece, start and length, in order."""
    n = -(-counts // most)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (counts - (n - 1) * most)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * most), np.where(piece == 0, first, most)


def best_two_fit(lengths: np.ndarray, most: int = SEQUENCE) -> list[list[int]]:
    """Bins of lengths; each length from 1 to `most`."""
    count = np.bincount(lengths, minlength=most + 1).tolist()
    # bit x of `have` stands for a length x that is left, bit (most - x) of `mirrored` for the same
    have = mirrored = 0
    for x in np.unique(lengths).tolist():
        have |= 1 << x
        mirrored |= 1 << (most - x)
    bins, whole = [[most]] * count[most], 1 << most
    if count[most]:
        have, mirrored = have & ~whole, mirrored & ~1

    def take(x: int) -> None:
        nonlocal have, mirrored
        count[x] -= 1
        if not count[x]:
            have &= ~(1 << x)
            mirrored &= ~(1 << (most - x))

    def put_back(x: int) -> None:
        nonlocal have, mirrored
        count[x] += 1
        have |= 1 << x
        mirrored |= 1 << (most - x)

    def two_for(room: int, above: int) -> tuple[int, int] | None:
        """Two lengths that are left with the largest sum up to `room`, if it is more than `above`."""
        if 2 * ((have & -have).bit_length() - 1) > room:
            return None
        for total in range(room, above, -1):
            pairs = have & (mirrored >> (most - total))
            if not total % 2 and count[total // 2] < 2:
                pairs &= ~(1 << (total // 2))
            if pairs:
                x = pairs.bit_length() - 1
                return x, total - x
        return None

    while have:
        gap, held, before, uses = most, [], have, Counter()
        while gap and (fits := have & ((2 << gap) - 1)):
            x = fits.bit_length() - 1
            take(x)
            uses[x] += 1
            held.append(x)
            gap -= x
        steady = have == before
        while gap and have:
            least = held[-1]
            pair = two_for(gap + least, least)
            if pair is None:
                break
            held.pop()
            put_back(least)
            for x in pair:
                take(x)
                uses[x] += 1
            steady &= have == before
            held = sorted([*held, *pair], reverse=True)
            gap -= sum(pair) - least
        bins.append(held)
        # what is left allows the same choices again until one of these lengths gets scarce
        again = min((count[x] - 2) // n for x, n in uses.items()) if steady else 0
        if again > 0:
            bins += [held] * again
            for x in held:
                count[x] -= again
    return bins


def placed(lengths: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the bin and the offset in it; pieces of one length are taken in order."""
    bins = best_two_fit(lengths, most)
    flat = np.fromiter((x for b in bins for x in b), np.int64, len(lengths))
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    which = np.repeat(np.arange(len(bins)), sizes)
    ends = np.cumsum(flat)
    offset = ends - flat - np.repeat((ends - flat)[np.cumsum(sizes) - sizes], sizes)
    sequence, at, order = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.argsort(lengths, kind="stable")
    slots = np.argsort(flat, kind="stable")
    sequence[order], at[order] = which[slots], offset[slots]
    return sequence, at


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, most: int = SEQUENCE) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, and their ids as 32-bit integers if asked for."""
    docs.sparkSession.sparkContext.addFile(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", FILE_TEXT):
                ids, counts = encoder(part.column("text"))
                doc, piece, start, length = cut(np.asarray(counts, np.int64), most)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                ends = np.cumsum(length)
                spans = list(zip((4 * (ends - length)).tolist(), (4 * ends).tolist(), strict=True))
                out = {"doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE + ", ids binary" * with_ids)


def packed(pieces: DataFrame, shard_pieces: int = SHARD_PIECES, most: int = SEQUENCE) -> DataFrame:
    """The pieces of a saved table, whose `row` tells them apart, with sequence_id and offset: where each lies."""
    shards = max(1, round(pieces.count() / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "row")

    def fill(rows: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).drop_columns("shard")
        sequence, offset = placed(table["length"].to_numpy(), most)
        yield from table.append_column("sequence_id", pa.array(sequence + (shard << 32))).append_column("offset", pa.array(offset)).to_batches(8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and lo < hi and int(shard[lo]) != at:
                    yield from fill(held, at)
                    held = []
                if lo < hi:
                    at = int(shard[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from fill(held, at)

    return dealt.mapInArrow(run, f"{_PIECE}, row long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, space: Workspace, shard_pieces: int = SHARD_PIECES, most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = space.save(tokenised(docs, tokenizer_path, False, most).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return packed(pieces, shard_pieces, most).drop("row")


def sequences(docs: DataFrame, tokenizer_path: str, space: Workspace, shard_pieces: int = SHARD_PIECES, most: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, its pieces (offset, doc_id, piece, length) in order, and its ids as 32-bit integers."""
    pieces = space.save(tokenised(docs, tokenizer_path, True, most).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = packed(pieces.drop("ids"), shard_pieces, most).select("row", "doc_id", "piece", "length", "sequence_id", "offset")
    rows = places.join(pieces.select("row", "ids"), "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    bare = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length")))
    return rows.select("sequence_id", bare.alias("pieces"), F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"))
