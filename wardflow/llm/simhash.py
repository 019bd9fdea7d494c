"""SimHash near-dedup: fingerprints, a binary-trie self-join within a Hamming budget, and components.

Distinct fingerprints are joined, never documents. Two fingerprints within k bits agree on one of k + 1 blocks, so
each fingerprint roots a sub-trie under every block value; a sub-trie with over NODE fingerprints is split again by
the blocks of its remaining bits, until at most a few bits are open. Inside a task the tries are walked from the top
bit, pairs of nodes together: a pair of children adds the bit in which they differ, and goes when it is over budget.
Found links are thinned to a forest in each task, and labels spread over the forest by joins until none changes.

Defined cases: null or empty texts have fingerprint 0, linked like any other; a text with fewer words than a shingle
is one shingle; null doc_ids are never the smallest of a component unless it has no other; equal rows share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace, free_name, lower_ascii, pieces, text_bytes, word_spans

SHINGLE = 3
BUDGET = 2
SEED = 42
#: Fingerprints of a sub-trie beyond which it is split by further blocks.
NODE = 256
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    raw, off = text_bytes(texts)
    starts, ends, before = word_spans(lower_ascii(raw), off)
    raw = lower_ascii(raw)
    lengths = ends - starts
    # words with one blank after each, so that a shingle is one slice
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    packed = np.full(at[-1], 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)
    packed[inside] = raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    view, digest = memoryview(packed), xxhash.xxh64_intdigest
    out = np.zeros(len(before) - 1, np.uint64)
    first, last = at[:-1], at[1:] - 1
    counts = np.diff(before)
    shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    for lo in range(0, len(out)):
        n, w = shingles[lo], before[lo]
        if n:
            span = min(shingle, counts[lo])
            a, b = first[w : w + n].tolist(), last[w + span - 1 : w + span - 1 + n].tolist()
            h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, n)
            set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[lo] = np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fingerprints_of(piece.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return _ONES[x.view(np.uint16).reshape(-1, 4)].sum(axis=1)


def walk(groups: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes i < j of fingerprints of one group within the budget. Rows must be sorted by group, then fingerprint."""
    fps = fps.astype(np.uint64, copy=False)
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    # node pairs: fingerprints [al, ah) and [bl, bh), bits in which they differ so far
    al, ah = lo[big], hi[big]
    bl, bh, err = al.copy(), ah.copy(), np.zeros(len(al), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(al):
            break
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i < j) & (_ones(fps[i] ^ fps[j]) <= budget)
            left.append(i[near])
            right.append(j[near])
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        zeros = np.zeros(len(fps) + 1, np.int64)
        np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0, out=zeros[1:])
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        same = al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        cross = ~same
        parts.append(tuple(x[cross] for x in (am, ah, bl, bm, err + 1)))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
    if len(al):  # leaves: equal fingerprints on either side
        width = bh - bl
        pairs = (ah - al) * width
        of = np.repeat(np.arange(len(al)), pairs)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = al[of] + k // width[of], bl[of] + k % width[of]
        left.append(i[i < j])
        right.append(j[i < j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, root) that connect what the links (a, b) connect, one for each vertex that isn't a root."""
    ids, inverse = np.unique(np.r_[a, b], return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def block_masks(open_mask: int, parts: int) -> list[int]:
    """The open bits cut into consecutive blocks of even size."""
    bits = [i for i in range(63, -1, -1) if open_mask >> i & 1]
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[cuts[k] : cuts[k + 1]]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, space: Workspace, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """Forest links (a, b) between distinct fingerprints (column fp) within the budget."""
    parts, found = budget + 1, None
    rows, paths = distinct.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), [0]  # fixed bits by path

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, fps = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, key))
        i, j = walk(key[order], fps[order], budget)
        if len(i):
            a, b = forest(fps[order][i].view(np.int64), fps[order][j].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    level = 0
    while True:
        grown = []
        for fixed in paths:
            grown += [fixed | m for m in block_masks(~fixed & (2**64 - 1), parts)]
        masks = F.array(*[F.lit(_signed(m)) for m in grown])
        split = rows.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda c: F.col("path") * parts + c)))
        split = split.withColumn("key", F.xxhash64("path", F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1))))
        split = space.save(split, f"trie-{level}")
        sizes = split.groupBy("key").count().where("count > 1")
        open_bits = 64 - min(bin(m).count("1") for m in grown)
        last = 2**open_bits <= node
        kept = sizes if last else sizes.where(F.col("count") <= node)
        step = split.join(kept.select("key"), "key").select("key", "fp").repartition("key").mapInArrow(leaf, "a long, b long")
        step = space.save(step, f"links-{level}")
        found = step if found is None else found.unionByName(step)
        if last:
            break
        rows = split.join(sizes.where(F.col("count") > node).select("key"), "key").select("fp", "path", "key")
        paths, level = grown, level + 1
        if not rows.head(1):
            break
    return found.distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b): the least vertex that it reaches.

    Labels take the least of their neighbours' and then of their label's label, so long chains halve in each round.
    """
    both = space.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = space.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("further"))
        stepped = space.save(lowered.join(jump, "to", "left").select("v", F.least("to", F.coalesce("further", "to")).alias("label"), "was"), f"labels-{turn}")
        space.drop(f"labels-{turn - 2}")
        changed = stepped.where("label <> was").head(1)
        labels = stepped.select("v", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, space: Workspace, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id (least doc_id of the component), one row per document."""
    prints = space.save(fingerprints(docs, shingle), "prints")
    distinct = space.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), space, budget), space)
    rooted = space.save(distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, space: Workspace, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The documents, one of each component: the row with the least doc_id. Equal doc_ids are rows of their own."""
    row_key = free_name(docs, "row_key")
    keyed = space.save(docs.withColumn(row_key, F.monotonically_increasing_id()), "keyed")
    groups = near_duplicates(keyed.select(F.col(row_key).alias("doc_id"), "text"), space, shingle, budget)
    named = groups.join(keyed.select(F.col(row_key).alias("doc_id"), F.col("doc_id").alias("named")), "doc_id")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("named").isNull(), "named", "doc_id"))["doc_id"].alias(row_key))
    return keyed.join(kept.select(row_key), row_key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
