"""LM scoring with a log-frequency Bloom filter.

A bigram model over tokens: words, then one end token for each document. Training counts of bigrams are quantised to
levels of a log scale; a key with level q is inserted under (key, 1) .. (key, q), so its count is read back by probing
level after level until one is missing. The number of distinct words seen after a context is kept the same way. The
probability is the Witten-Bell mix of the bigram estimate and the add-one unigram estimate:
P(w | h) = (c(hw) + T(h) * P(w)) / (c(h) + T(h)), with exact c(h) and P(w).

The filter is a segment for each hash bucket, sized by what the bucket holds, and is always broadcast to the workers: in
rounds, each of the segments of consecutive buckets that take up to BROADCAST_FILTER bytes together. Each probe belongs
to one round, so more rounds mean more broadcasts, not more probes. Unigram counts and context totals come back to each
chunk for its own words only.

Words are told apart by 64 bits of one hash and the bucket of a second one.

Defined cases: null or empty texts are the end token alone; null doc_ids belong to training; without any training
token all counts are 0; equal rows count as often as they are there; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._chunks import CHUNK_TEXT, Words, answered, bucket_count, packed, rows, runs, scaled, to_chunks, unpacked
from wardflow.llm._util import Workspace, mix64

#: Bytes of filter segments that are broadcast to the workers at once, about (a larger segment is a round of its own).
BROADCAST_FILTER = 192 << 20
#: Hash functions for each level; a probe of something absent succeeds with about 2 ** -PROBES.
PROBES = 7
BITS_PER_ENTRY = PROBES / np.log(2)
BASE = 1.4
HELD_OUT = (7, 2)
_START = np.unique(np.ceil(BASE ** np.arange(0, 120)).astype(np.int64))  # least count of each level
_VALUE = np.r_[0.0, (_START[:-1] + _START[1:] - 1) / 2, float(_START[-1])]  # count that a level stands for
_CONTEXT = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_ids: np.ndarray, missing: np.ndarray) -> np.ndarray:
    return ~missing & np.array([zlib.crc32(str(x).encode()) % HELD_OUT[0] == HELD_OUT[1] for x in doc_ids.tolist()], bool)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_START, counts, side="right")


_LOW = np.uint64(0xFFFFFFFF)


def _mixed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of each key's probes for a level, as 32-bit fractions of a segment."""
    a = mix64(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return a >> np.uint64(32), (a & _LOW) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, probe: int, size) -> np.ndarray:
    return (((first + np.uint64(probe) * step) & _LOW) * size) >> np.uint64(32)


def build(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """A filter segment: its number of bits (under 2 ** 32), and the bits."""
    level = levels(counts)
    size = max(64, int(np.ceil(level.sum() * BITS_PER_ENTRY)))
    mark = np.zeros(size, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        first, step = _mixed(keys[level >= k], k)
        for probe in range(PROBES):
            mark[_place(first, step, probe, np.uint64(size))] = True
    return size, np.packbits(mark, bitorder="little").tobytes()


class Filter:
    """Segments of some buckets, one after the other; others are empty."""

    def __init__(self, n: int, segments: list[tuple[int, int, bytes]]):
        self.size, self.start = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        at = 0
        for bucket, size, data in segments:
            self.size[bucket], self.start[bucket] = size, 8 * at
            at += len(data)
        self.data = np.frombuffer(b"".join(data for _, _, data in segments), np.uint8)

    def read(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key in its bucket: probes go on while levels are found. Keys in bucket order stay in the cache."""
        level, k = np.zeros(len(keys), np.uint8), 0
        alive = np.flatnonzero(self.size[bucket] > 0)
        size, start = self.size[bucket[alive]], self.start[bucket[alive]]
        while len(alive) and k < len(_START):
            k += 1
            first, step = _mixed(keys[alive], k)
            for probe in range(PROBES):
                at = _place(first, step, probe, size) + start
                hit = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    alive, first, step, size, start = alive[hit], first[hit], step[hit], size[hit], start[hit]
            level[alive] = k
        return level


class Text(Words):
    """A chunk's tokens: codes of words, the end token last in the vocabulary."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.end = len(self.vocabulary)
        self.word_hash = np.r_[self.word_hash, np.uint64(0xD1B54A32D192ED03)]
        self.held = held_out(self.doc_ids, self.missing)
        self.tokens = np.insert(self.codes.astype(np.int64), self.ends, self.end)
        self.n_tokens = self.counts + 1
        self.train = np.repeat(~self.held, self.n_tokens)
        self.first = np.cumsum(self.n_tokens) - self.n_tokens

    def word_order(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary in bucket order, and its buckets."""
        bucket = scaled(mix64(self.word_hash ^ np.uint64(0xA0761D6478BD642F)), n).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def take_totals(self, row: dict, n: int) -> None:
        """Sets c, the training count of each word of the vocabulary, from the answers."""
        order, bucket = self.word_order(n)
        got = {a["bucket"]: a["bits"] for a in row["totals"] or ()}
        self.c = np.zeros(len(order), np.int64)
        for b, i, j in runs(bucket):
            self.c[order[i:j]] = np.frombuffer(unpacked(got[b]), np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) codes and each token's place among them."""
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.first] = self.end
        pair, place = np.unique(context * (self.end + 1) + self.tokens, return_inverse=True)
        return pair // (self.end + 1), pair % (self.end + 1), place

    def keys(self, context: np.ndarray, word: np.ndarray, n: int, hot: float) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32-bit key of bigrams. Bigrams of a context are together, but for hot contexts, which are spread."""
        h = mix64(self.word_hash[context] * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[word] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        bucket = np.where(self.c[context] > hot, scaled(h, n), scaled(mix64(self.word_hash[context] ^ _CONTEXT), n)).astype(np.int64)
        return bucket, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sum_words(table: pa.Table) -> pa.Table:
    """Unigrams of one bucket: total of each key to all chunks that hold it; sums for the whole bucket on its first row."""
    parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(unpacked(x), np.uint32) for x in table["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)
    split = np.split(total[place], np.cumsum([len(p) for p in parts])[:-1])
    rest = [0] * (len(parts) - 1)
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array([packed(x) for x in split], pa.binary()), "tokens": pa.array([int(total.sum()), *rest], pa.int64()), "distinct": pa.array([int((total > 0).sum()), *rest], pa.int64())})


def _context_keys(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ _CONTEXT) | np.uint64(1 << 63)


def _segment(table: pa.Table) -> pa.Table:
    """The filter segment of one bucket, and the continuation counts of hot contexts as far as they lie here."""
    sizes = [np.frombuffer(unpacked(x), np.uint32) for x in table["sizes"].to_pylist()]
    context = np.concatenate([np.repeat(np.frombuffer(h, np.uint64), n) for h, n in zip(table["contexts"].to_pylist(), sizes, strict=True)])
    hot = np.concatenate([np.repeat(np.frombuffer(unpacked(h), np.uint8), n) for h, n in zip(table["hot"].to_pylist(), sizes, strict=True)]).astype(bool)
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]).astype(np.uint64)
    counts = np.concatenate([np.frombuffer(unpacked(x), np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
    names, which = np.unique(context, return_inverse=True)
    pair, place = np.unique(which.astype(np.uint64) << np.uint64(32) | keys, return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)
    of = (pair >> np.uint64(32)).astype(np.int64)
    follow = np.bincount(of, minlength=len(names))
    is_hot = np.zeros(len(names), bool)
    is_hot[which[hot]] = True
    # the same 32-bit key under two contexts is one key of the filter, as the larger count
    all_keys = np.r_[pair & np.uint64(0xFFFFFFFF), _context_keys(names[~is_hot])]
    all_counts = np.r_[total, follow[~is_hot]]
    size, data = build(all_keys, all_counts)
    return pa.table({"bucket": table["bucket"].slice(0, 1), "size": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary()), "hot_contexts": pa.array([names[is_hot].view(np.int64)], pa.list_(pa.int64())), "hot_follow": pa.array([follow[is_hot].astype(np.int64)], pa.list_(pa.int64()))})


class Probes:
    """What a chunk asks of the filter: its bigrams whose two words are known, and its known contexts, bucket by bucket."""

    def __init__(self, text: Text, n: int, hot: float):
        self.text = text
        self.context, self.word, self.place = text.bigrams()
        self.asked = np.flatnonzero((text.c[self.context] > 0) & (text.c[self.word] > 0))
        bucket, key = text.keys(self.context[self.asked], self.word[self.asked], n, hot)
        order = np.argsort(bucket, kind="stable")
        self.asked, self.bucket, self.key = self.asked[order], bucket[order], key[order]
        self.names = np.flatnonzero((text.c > 0) & (text.c <= hot))
        at = scaled(mix64(text.word_hash[self.names] ^ _CONTEXT), n).astype(np.int64)
        order = np.argsort(at, kind="stable")
        self.names, self.at = self.names[order], at[order]
        self.name_keys = _context_keys(text.word_hash[self.names])

    def parts(self, low: int, high: int) -> tuple[slice, slice]:
        """Its bigrams and its contexts in buckets [low, high)."""
        return (slice(*np.searchsorted(x, (low, high)).tolist()) for x in (self.bucket, self.at))

    def levels(self, filters: Filter, low: int, high: int) -> np.ndarray:
        """Levels of the bigrams, then of the contexts, in buckets [low, high)."""
        mine, theirs = self.parts(low, high)
        return np.r_[filters.read(self.bucket[mine], self.key[mine].astype(np.uint64)), filters.read(self.at[theirs], self.name_keys[theirs])]

    def score(self, answers: list[tuple[int, int, np.ndarray]], follow: dict[int, int], tokens: int, distinct: int) -> pa.RecordBatch:
        """answers: (low, high, levels) of each round. follow: continuation counts of hot contexts."""
        text = self.text
        c_pair, t = np.zeros(len(self.context)), np.zeros(len(text.c))
        for low, high, got in answers:
            mine, theirs = self.parts(low, high)
            k = mine.stop - mine.start
            c_pair[self.asked[mine]] = _VALUE[got[:k]]
            t[self.names[theirs]] = _VALUE[got[k:]]
        if follow:
            by_hash = np.array([follow.get(int(h), 0) for h in text.word_hash.view(np.int64)]) if len(text.c) else np.zeros(0)
            t = np.where(by_hash > 0, by_hash, t)
        c = text.c.astype(float)
        t = np.where(c > 0, np.clip(t, 1, np.maximum(c, 1)), 0)
        unigram = (c + 1) / (tokens + distinct + 1)
        c_pair = np.minimum(c_pair, np.minimum(c[self.context], c[self.word]))
        h = self.context
        p = np.where(c[h] > 0, (c_pair + t[h] * unigram[self.word]) / np.maximum(c[h] + t[h], 1), unigram[self.word])
        add = lambda x: np.add.reduceat(x, text.first)
        ids = [None if gone else x for x, gone in zip(text.doc_ids.tolist(), text.missing.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(text.held),
                "n_tokens": pa.array(text.n_tokens, pa.int64()),
                "n_known": pa.array(add((text.c > 0).astype(np.int64)[text.tokens]), pa.int64()),
                "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
                "base_score": pa.array(add(np.log10(unigram)[text.tokens]), pa.float64()),
                "score": pa.array(add(np.log10(p)[self.place]), pa.float64()),
            }
        )


def rounds(sizes: dict[int, int], n: int, most: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of buckets 0..n whose segments take up to `most` bytes each, or hold one bucket."""
    out, low, held = [], 0, 0
    for b in range(n):
        if b > low and held + sizes.get(b, 0) > most:
            out.append((low, b))
            low, held = b, 0
        held += sizes.get(b, 0)
    return [*out, (low, n)]


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, space: Workspace, chunk_text: int = CHUNK_TEXT, broadcast_filter: int = BROADCAST_FILTER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), one row per document."""
    spark = docs.sparkSession
    chunks = space.save(to_chunks(docs, chunk_text, lower=True), "chunks")
    n = bucket_count(chunks)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            text = Text(row)
            order, bucket = text.word_order(n)
            counts = np.bincount(text.tokens[text.train], minlength=len(order)).astype(np.uint32)[order]
            keys, held = text.word_hash[order], list(runs(bucket))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in held], pa.int64()), "chunk": pa.array([row["chunk"]] * len(held), pa.int64()), "keys": pa.array([keys[i:j].tobytes() for _, i, j in held], pa.binary()), "counts": pa.array([packed(counts[i:j]) for _, i, j in held], pa.binary())})

    sent = chunks.mapInArrow(send_words, "bucket long, chunk long, keys binary, counts binary")
    totals = space.save(sent.groupBy("bucket").applyInArrow(_sum_words, "chunk long, bucket long, bits binary, tokens long, distinct long"), "totals")
    sums = totals.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = sums[0] or 0, sums[1] or 0
    hot = tokens / (4 * n)
    counted = space.save(answered(chunks, totals.select("chunk", "bucket", "bits"), "totals"), "counted")
    space.drop("chunks")
    space.drop("totals")

    def send_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            text = Text(row)
            text.take_totals(row, n)
            context, word, place = text.bigrams()
            counts = np.bincount(place[text.train], minlength=len(context))
            some = np.flatnonzero(counts)
            context, word, counts = context[some], word[some], counts[some].astype(np.uint32)
            bucket, key = text.keys(context, word, n, hot)
            order = np.lexsort((context, bucket))
            context, counts, bucket, key = context[order], counts[order], bucket[order], key[order]
            out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "contexts", "sizes", "hot", "keys", "counts")}
            for b, i, j in runs(bucket):
                edge = np.flatnonzero(np.r_[True, context[i:j][1:] != context[i:j][:-1], True])
                names = context[i:j][edge[:-1]]
                for k, v in zip(out, (b, row["chunk"], text.word_hash[names].tobytes(), packed(np.diff(edge).astype(np.uint32)), packed((text.c[names] > hot).astype(np.uint8)), key[i:j].tobytes(), packed(counts[i:j])), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()})

    sent = counted.mapInArrow(send_bigrams, "bucket long, chunk long, contexts binary, sizes binary, hot binary, keys binary, counts binary")
    segments = space.save(sent.groupBy("bucket").applyInArrow(_segment, "bucket long, size long, data binary, hot_contexts array<bigint>, hot_follow array<bigint>"), "segments")
    # a hot context holds over 1 / (4 n) of all tokens, so there are under 4 n of them
    follow = {r.h: r.t for r in segments.select(F.explode(F.arrays_zip("hot_contexts", "hot_follow")).alias("x")).groupBy(F.col("x.hot_contexts").alias("h")).agg(F.sum("x.hot_follow").alias("t")).collect()}
    lengths = segments.select("bucket", F.length("data").alias("n")).collect()  # one small row for each bucket
    cuts = rounds({r.bucket: r.n for r in lengths}, n, broadcast_filter)

    def in_round(low: int, high: int):
        """The filter of buckets [low, high), broadcast."""
        held = [(r.bucket, r.size, bytes(r.data)) for r in segments.where((F.col("bucket") >= low) & (F.col("bucket") < high)).select("bucket", "size", "data").toLocalIterator()]
        return spark.sparkContext.broadcast(Filter(n, held))

    def probes_of(row: dict) -> Probes:
        text = Text(row)
        text.take_totals(row, n)
        return Probes(text, n, hot)

    if len(cuts) == 1:  # the levels are used where they are read
        (low, high), everywhere = cuts[0], in_round(*cuts[0])

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                probes = probes_of(row)
                yield probes.score([(low, high, probes.levels(everywhere.value, low, high))], follow, tokens, distinct)

        return counted.mapInArrow(at_once, OUT)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            probes = probes_of(row)
            out: dict[str, list] = {k: [] for k in ("round", "chunk", "buckets", "keys", "at", "names")}
            for k, (low, high) in enumerate(cuts):
                mine, theirs = probes.parts(low, high)
                for name, v in zip(out, (k, row["chunk"], packed(probes.bucket[mine]), probes.key[mine].tobytes(), packed(probes.at[theirs]), probes.name_keys[theirs].tobytes()), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("round", "chunk") else pa.binary()) for k, v in out.items()})

    questions = space.save(counted.mapInArrow(asked, "round long, chunk long, buckets binary, keys binary, at binary, names binary"), "asked", "round")
    found = None
    for k, (low, high) in enumerate(cuts):
        everywhere = in_round(low, high)

        def answer(batches: Iterator[pa.RecordBatch], everywhere=everywhere) -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                bigrams = everywhere.value.read(np.frombuffer(unpacked(row["buckets"]), np.int64), np.frombuffer(row["keys"], np.uint32).astype(np.uint64))
                contexts = everywhere.value.read(np.frombuffer(unpacked(row["at"]), np.int64), np.frombuffer(row["names"], np.uint64))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]], pa.int64()), "bucket": pa.array([row["round"]], pa.int64()), "bits": pa.array([packed(np.r_[bigrams, contexts])], pa.binary())})

        got = space.save(questions.where(F.col("round") == k).mapInArrow(answer, "chunk long, bucket long, bits binary"), f"levels-{k}")
        everywhere.unpersist()
        found = got if found is None else found.unionByName(got)

    def from_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            got = [(*cuts[a["bucket"]], np.frombuffer(unpacked(a["bits"]), np.uint8)) for a in row["levels"] or ()]
            yield probes_of(row).score(got, follow, tokens, distinct)

    return answered(counted, found, "levels").mapInArrow(from_answers, OUT)
