"""Token-ID output: whole texts to ids, Simple-8b files in ascending doc_id order, and their reader.

A file is a row of a Parquet table in the shared folder, so Spark's commit protocol writes it on any store and a lost
executor's attempt leaves nothing: (part, seg, doc_ids, doc_tokens, image), image as `simple8b` says. Documents are
range-partitioned by doc_id; a file holds whole documents, about FILE_TEXT bytes of text, or one longer document.

Defined cases: a null or empty text has only the end id; null doc_ids come first; documents with equal doc_ids follow
each other in the order of a hash of their texts; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm import simple8b
from wardflow.llm._util import Workspace, pieces, text_bytes

END_ID = 0
FILE_TEXT = 2 << 20
#: Units whose ids a worker keeps, and the characters of the longest one; others are encoded anew in each file.
CACHE_UNITS = 400_000
CACHE_CHARS = 40
#: Units that are encoded as one string, and such strings at once.
JOINED = 128
STRINGS = 64
_ASCII_SPACE = " \t\n\v\f\r"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _wide_space_ends(raw: np.ndarray) -> np.ndarray:
    """Where the last byte of a white-space character beyond ASCII may lie; what follows it is never split off."""
    out = np.zeros(len(raw), bool)
    if len(raw) < 2 or not (raw >= 0xC2).any():
        return out
    one, two = raw[:-1], raw[1:]
    out[1:] = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    if len(raw) > 2:
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        out[2:] |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return out


class Encoder:
    """Ids of texts, working on each distinct unit (white space and the run of other characters after it) once.

    A byte-level pre-tokeniser never joins a character to white space that follows it, so the ids of a text are those
    of its units one after the other. White space beyond the six ASCII characters never starts a unit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.width = np.dtype("H" if self.tokenizer.get_vocab_size() <= 65_536 else "I")
        # a character of a byte-level token stands for a byte
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))

    def _encoded(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _joined(self, groups: list[list[str]], sizes: list[np.ndarray]) -> list[bytes]:
        """The ids of each unit of the groups, of these sizes in bytes, whose units are encoded as one string each. The bytes that tokens stand for tell where a unit ends; a group in which
        no token ends there is encoded unit by unit."""
        out = []
        for group, size, ids in zip(groups, sizes, self._encoded(["".join(g) for g in groups]), strict=True):
            ids = np.array(ids, self.width)
            ends = np.cumsum(self.bytes_of[ids])
            want = np.cumsum(size)
            cut = np.searchsorted(ends, want)
            if len(group) > 1 and (not len(ends) or ends[-1] != want[-1] or (ends[cut] != want).any()):
                out += [array(self.width.char, x).tobytes() for x in self._encoded(group)]
                continue
            raw, at = ids.tobytes(), [0, *((cut[:-1] + 1) * self.width.itemsize).tolist(), len(ids) * self.width.itemsize]
            out += [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def _unit_ids(self, units: list[str], sizes: np.ndarray) -> list[bytes]:
        """The ids of each unit, as bytes of the tokenizer's id width; sizes: the units' bytes."""
        known = self.known
        out = list(map(known.get, units))
        missing = [i for i, x in enumerate(out) if x is None]
        # only a unit that begins with white space and doesn't end with it can stand between others
        alone = [i for i in missing if units[i][0] not in _ASCII_SPACE or units[i][-1].isspace()]
        if alone:
            apart = set(alone)
            missing = [i for i in missing if i not in apart]
        groups = [missing[at : at + JOINED] for at in range(0, len(missing), JOINED)] + [[i] for i in alone]
        for at in range(0, len(groups), STRINGS):
            part = groups[at : at + STRINGS]
            flat = [i for g in part for i in g]
            for i, x in zip(flat, self._joined([[units[i] for i in g] for g in part], [sizes[g] for g in part]), strict=True):
                out[i] = x
            if len(known) < CACHE_UNITS:
                known.update((units[i], out[i]) for i in flat if len(units[i]) <= CACHE_CHARS)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by END_ID, and the number of ids of each."""
        raw, off = text_bytes(texts)
        space = _SPACE[raw]
        start = space.copy()
        start[1:] &= ~space[:-1] & ~_wide_space_ends(raw)[:-1]
        start[off[:-1][off[:-1] < len(raw)]] = True
        starts = np.flatnonzero(start)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        ids = self._unit_ids(units.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(units.dictionary).to_numpy())
        ids.append(array(self.width.char, [END_ID]).tobytes())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        first = np.zeros(len(ids), np.int64)
        np.cumsum(lengths[:-1], out=first[1:])
        pool = np.frombuffer(b"".join(ids), self.width)
        before = np.searchsorted(starts, off[1:])  # units up to the end of each text
        codes = np.insert(units.indices.to_numpy().astype(np.int64), before, len(ids) - 1)
        counts = lengths[codes]
        ends = np.cumsum(counts)
        out = pool[np.repeat(first[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        doc_ends = ends[before + np.arange(len(before))]
        return out, np.diff(doc_ends, prepend=0)


FILE_SCHEMA = "part int, seg int, doc_ids array<bigint>, doc_tokens array<bigint>, image binary"
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which keeps the units of earlier tasks. Workers import this function, so they share one table.

    Where the driver's path isn't there, the copy that Spark sent to the executor is read.
    """
    if path not in _encoders:
        _encoders[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _encoders[path]


def write_ids(docs: DataFrame, tokenizer_path: str, space: Workspace, name: str = "token-files") -> DataFrame:
    """Writes the files and returns their table."""
    docs.sparkSession.sparkContext.addFile(tokenizer_path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        part, seg = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text", FILE_TEXT):
                ids, counts = encoder(piece.column("text"))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), "doc_tokens": pa.array([counts], pa.list_(pa.int64())), "image": pa.array([simple8b.encode(ids)], pa.binary())})
                seg += 1

    # the hash splits what has one doc_id, or none
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return space.save(ordered.mapInArrow(code, FILE_SCHEMA), name)


def read_ids(files: DataFrame) -> DataFrame:
    """Decodes the files: doc_id, start (ids before the document), n_tokens, ids_crc32 (of the ids as u32)."""
    sized = files.select("part", "seg", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = sized.select("part", "seg", (F.sum("n").over(Window.partitionBy("part").orderBy("seg")) - F.col("n")).alias("seg_start"))
    at = inside.join(base, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("file_start"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                image, counts = row.column("image")[0].as_buffer(), np.array(row.column("doc_tokens")[0].values, np.int64)
                ids = simple8b.decode(image).astype("<u4")
                ends = np.cumsum(counts)
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                start = row.column("file_start")[0].as_py() + ends - counts
                yield pa.RecordBatch.from_pydict({"doc_id": row.column("doc_ids")[0].values, "start": pa.array(start, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.join(at, ["part", "seg"]).select("file_start", "doc_ids", "doc_tokens", "image").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
