"""Substring dedup with difference-cover anchors.

A window is WINDOW = 13 consecutive words. Anchors are 7-word windows that start at word positions congruent to 1, 2
or 4 modulo 7. Those residues are a difference cover: for any two positions there is a shift under 7 after which both
are cover positions, so two equal 13-word windows always share an aligned anchor inside (7 + 7 - 1 = 13). Only windows
around anchors that some other document or chunk also holds are extended and compared in full.

Texts are read once into chunks (a row holds the documents of about CHUNK_TEXT bytes as word codes and a vocabulary).
A chunk sends each hash bucket its distinct hashes in one row, and gets one bit back for each: shared or not, then
held by a smaller doc_id or not. A passage in a million documents is one entry per chunk; no pairs are made. Rows sent
are at most the anchors, whatever the numbers of chunks and buckets.

Window equality is judged by 64 bits of one hash and the bucket of a second one.

Defined cases: null or empty texts have no words; texts under 13 words keep everything; a null doc_id counts as larger
than any other; documents with equal doc_ids don't remove from each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardflow.llm._chunks import CHUNK_TEXT, Words, answered, bits, bucket_count, rows, runs, scaled, to_chunks
from wardflow.llm._util import Workspace, mix64

WINDOW = 13
ANCHOR = 7
COVER = (1, 2, 4)


class Chunk(Words):
    """A chunk's words, and hashes of its windows."""

    def __init__(self, row: dict):
        super().__init__(row)
        n = row["n_words"]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = self.word_hash[self.codes]
        self.place = np.arange(n) - np.repeat(self.ends - self.counts, self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(n)  # words from here to the document's end

    def window_hash(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        """Hash of the `size` words from each position."""
        out = np.zeros(len(at), np.uint64)
        for k, odd in enumerate(np.random.default_rng(seed).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
            out += self.hashes[at + k] * odd
        return mix64(out)

    def anchors(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchor positions and keys: bucket in the upper half, 32 bits of hash in the lower."""
        at = np.flatnonzero(np.isin(self.place % ANCHOR, COVER) & (self.left >= ANCHOR))
        h = self.window_hash(at, ANCHOR, 1)
        return at, (scaled(h, n_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def candidates(self, shared_at: np.ndarray) -> np.ndarray:
        """Windows that hold a shared anchor."""
        near = np.zeros(len(self.codes) + 1, np.int32)
        np.add.at(near, np.maximum(shared_at - (WINDOW - ANCHOR), 0), 1)
        np.add.at(near, shared_at + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= WINDOW))

    def windows(self, at: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in bucket order: bucket, hash, least doc_id here; and each window's place among them."""
        h = self.window_hash(at, WINDOW, 2)
        bucket = scaled(self.window_hash(at, WINDOW, 3), n_buckets)
        order = np.lexsort((h, bucket))
        h, bucket = h[order], bucket[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])] if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.doc_ids[self.doc[at[order]]], first) if len(first) else np.zeros(0, np.int64)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        return bucket[first].astype(np.int64), h[first], least, place


def _anchor_sets(chunk: Chunk, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions; distinct keys in order; for each whether two documents here hold it; each anchor's place."""
    at, key = chunk.anchors(n_buckets)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1 if len(key) else first
    doc = chunk.doc[at[order]]
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return at, sorted_key[first], doc[first] != doc[last], place


def _shared(table: pa.Table) -> pa.Table:
    """For the anchors of one bucket: which are held by two documents, one bit each."""
    parts = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order] = np.r_[False, same] | np.r_[same, False]
    sizes = [len(p) for p in parts]
    flags |= np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["multi"].to_pylist(), sizes, strict=True)]).astype(bool)
    packed = [bits(x) for x in np.split(flags, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(packed, pa.binary())})


def _earlier(table: pa.Table) -> pa.Table:
    """For the windows of one bucket: which a smaller doc_id than the chunk's least one also holds, one bit each."""
    parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    keys = np.concatenate(parts)
    least = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b if w == 4 else np.frombuffer(x, np.int64) for x, b, w in zip(table["least"].to_pylist(), table["base"].to_pylist(), table["width"].to_pylist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))
    flags = np.zeros(len(keys), bool)
    flags[order] = first[np.cumsum(new) - 1] < least[order]
    packed = [bits(x) for x in np.split(flags, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(packed, pa.binary())})


def _flags(answers: list[dict], bucket_of: np.ndarray) -> np.ndarray:
    """The answer bits in the order of the chunk's keys."""
    got = {a["bucket"]: a["bits"] for a in answers or ()}
    out = np.zeros(len(bucket_of), bool)
    for b, lo, hi in runs(bucket_of):
        out[lo:hi] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo)
    return out


def remove_repeats(docs: DataFrame, space: Workspace, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one blank), one row per document."""
    chunks = space.save(to_chunks(docs, chunk_text), "chunks")
    n = bucket_count(chunks)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            _, key, multi, _ = _anchor_sets(Chunk(row), n)
            low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            held = list(runs((key >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in held], pa.int64()), "chunk": pa.array([row["chunk"]] * len(held), pa.int64()), "keys": pa.array([low[i:j].tobytes() for _, i, j in held], pa.binary()), "multi": pa.array([bits(multi[i:j]) for _, i, j in held], pa.binary())})

    sent = chunks.mapInArrow(send_anchors, "bucket long, chunk long, keys binary, multi binary")
    shared = space.save(sent.groupBy("bucket").applyInArrow(_shared, "chunk long, bucket long, bits binary"), "shared")

    def candidate_windows(chunk: Chunk, answers: list[dict]):
        at, key, _, place = _anchor_sets(chunk, n)
        return chunk.candidates(at[_flags(answers, (key >> np.uint64(32)).astype(np.int64))[place]])

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            chunk = Chunk(row)
            bucket, key, least, _ = chunk.windows(candidate_windows(chunk, row["shared"]), n)
            base = int(least.min()) if len(least) else 0
            width = 4 if len(least) and int(least.max()) - base < 2**32 else 8
            small = (least - base).astype(np.uint32) if width == 4 else least
            held = list(runs(bucket))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in held], pa.int64()), "chunk": pa.array([row["chunk"]] * len(held), pa.int64()), "keys": pa.array([key[i:j].tobytes() for _, i, j in held], pa.binary()), "least": pa.array([small[i:j].tobytes() for _, i, j in held], pa.binary()), "base": pa.array([base] * len(held), pa.int64()), "width": pa.array([width] * len(held), pa.int32())})

    sent = answered(chunks, shared, "shared").mapInArrow(send_windows, "bucket long, chunk long, keys binary, least binary, base long, width int")
    earlier = space.save(sent.groupBy("bucket").applyInArrow(_earlier, "chunk long, bucket long, bits binary"), "earlier")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            chunk = Chunk(row)
            at = candidate_windows(chunk, row["shared"])
            bucket, _, least, place = chunk.windows(at, n)
            gone = at[_flags(row["earlier"], bucket)[place] | (chunk.doc_ids[chunk.doc[at]] > least[place])]
            cover = np.zeros(len(chunk.codes) + WINDOW + 1, np.int32)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            kept = np.cumsum(cover[: len(chunk.codes)]) == 0
            words, ends = chunk.vocabulary, chunk.ends.tolist()
            held = np.r_[0, np.cumsum(kept)][np.r_[0, chunk.ends]]
            codes = chunk.codes[kept].tolist()
            texts = [b" ".join([words[c] for c in codes[i:j]]) for i, j in zip(held[:-1].tolist(), held[1:].tolist(), strict=True)]
            ids = pa.array(row["doc_ids"], pa.int64())
            for lo in range(0, len(ends), 2000):
                part = slice(lo, lo + 2000)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[part], "n_words": pa.array(chunk.counts[part]), "n_removed": pa.array((chunk.counts - np.diff(held))[part]), "text": pa.array(texts[part], pa.binary()).cast(pa.string())})

    return answered(answered(chunks, shared, "shared"), earlier, "earlier").mapInArrow(keep, "doc_id long, n_words long, n_removed long, text string")
