"""Helpers the corpus operators share: the shared work folder, saved tables, and word spans of Arrow texts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: blank and \t \n \v \f \r, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only in a local session where that is unset."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = f"file://{tempfile.mkdtemp(prefix='wardflow-')}"
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


class Workspace:
    """Tables written to the shared folder to cut lineage; what is no longer needed is dropped early, the rest at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/wardflow-{uuid.uuid4().hex}"
        self._saved: dict[str, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str, *parted: str) -> DataFrame:
        """Writes the table, a folder for each value of the columns `parted`, and returns it as read back. An earlier table of that name stays until it is dropped by `clear`."""
        self._saved[name] = at = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        (df.write.partitionBy(*parted) if parted else df.write).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Deletes the table last saved under the name."""
        if name in self._saved:
            self._delete(self._saved.pop(name))

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: the folder goes with it
            pass

    def _delete(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids up to which a join broadcasts them (about 30 MB); beyond it both sides are shuffled.
NARROW_ROWS = 2_000_000


def narrow(ids: DataFrame) -> DataFrame:
    """A table of one id column, broadcast in joins if it is small when counted."""
    return F.broadcast(ids) if ids.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS else ids.hint("merge")


def buckets(spark: SparkSession) -> int:
    """How many hash buckets of rows to aim at: as many as the session's shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a batch's texts, one after the other, and the offsets (one more than texts); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and for each text the number of words before it (one more than texts); between: which bytes are in no word."""
    inside = ~between[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array; ranges ascend and don't overlap."""
    keep = np.zeros(len(raw) + 1, np.int8)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    data = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in slices of about `limit` bytes of text each (a longer text stands alone), to bound memory."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
    start, held = 0, 0.0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0.0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
