"""Texts as chunks of word codes, and the exchange of one row per chunk and hash bucket.

A chunk row holds the documents of about CHUNK_TEXT bytes (or one longer document): doc_ids, words of each, a code for
each word and the vocabulary. A chunk asks about its distinct keys with one row for each bucket that they hash to, and
the bucket answers with one row for each that asked: hot keys cost one entry per chunk, and rows never exceed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import buckets, gather, lower_ascii, pieces, text_bytes, word_spans

CHUNK_TEXT = 4 << 20
#: Words for each bucket at most, so that a bucket's task stays small.
BUCKET_WORDS = 8_000_000
#: What a null doc_id sorts as; `missing` tells it from a real one.
LAST = np.iinfo(np.int64).max

CHUNK_SCHEMA = "chunk long, doc_ids array<bigint>, counts array<int>, codes binary, vocabulary binary, n_words long"


def to_chunks(docs: DataFrame, chunk_text: int = CHUNK_TEXT, lower: bool = False) -> DataFrame:
    """The documents as rows of word codes; lower: A-Z count as a-z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text", chunk_text):
                raw, off = text_bytes(piece.column("text"))
                raw = lower_ascii(raw) if lower else raw
                starts, ends, before = word_spans(raw, off)
                coded = gather(raw, starts, ends).dictionary_encode()
                offsets, data = (np.frombuffer(b, t) for b, t in zip(coded.dictionary.buffers()[1:], (np.int64, np.uint8), strict=True)) if len(starts) else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
                spaced = np.insert(data[: offsets[len(coded.dictionary)]], offsets[1 : len(coded.dictionary) + 1], 32)
                codes = np.asarray(coded.indices, np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([part << 32 | seq], pa.int64()),
                        "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        "counts": pa.array([np.diff(before)], pa.list_(pa.int32())),
                        "codes": pa.array([pa.compress(codes.tobytes(), "zstd", asbytes=True)], pa.binary()),
                        "vocabulary": pa.array([pa.compress(spaced.tobytes(), "zstd", asbytes=True)], pa.binary()),
                        "n_words": pa.array([len(codes)], pa.int64()),
                    }
                )
                seq += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK_SCHEMA)


class Words:
    """A chunk row, unpacked."""

    def __init__(self, row: dict):
        n = row["n_words"]
        self.doc_ids = np.array([LAST if x is None else x for x in row["doc_ids"]], np.int64)
        self.missing = np.array([x is None for x in row["doc_ids"]], bool)
        self.counts = np.array(row["counts"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.codes = np.frombuffer(unpacked(row["codes"]), np.int32) if n else np.zeros(0, np.int32)
        self.vocabulary = unpacked(row["vocabulary"]).split()
        digest = xxhash.xxh64_intdigest
        self.word_hash = np.fromiter((digest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read() if data else b""


def runs(sorted_ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(id, from, to) of the runs of equal ids."""
    edge = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1], True]) if len(sorted_ids) else np.zeros(1, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(sorted_ids[a]), a, b


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def answered(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The chunks with their answers as an array column."""
    return chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), "chunk", "left")


def bucket_count(chunks: DataFrame) -> int:
    """Hash buckets for the chunks' keys: several for each shuffle partition, and more where words are many."""
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    return 4 * max(buckets(chunks.sparkSession), -(-total // (4 * BUCKET_WORDS)))


def scaled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes to 0..n-1 by their upper half."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
