"""SimHash near-dedup at a Jaccard similarity: documents whose sets of five-word shingles are alike to 0.8 or more.

At 0.8 two fingerprints of 64 bits differ in about 10 bits, seldom over 20. No block of bits is then sure to agree, so the
tries of operator 3 get other roots: every shingle of a document's prefix roots a trie of the fingerprints that hold it.
Under any one order of all shingles, sets alike to the threshold share one of their first n - ceil(0.8 n) + 1, so pairs
meet under some root; there the trie is walked, pairs of nodes together, and what differs in over BUDGET bits goes. The
order puts shingles that are common in a part of the corpus last; that part decides the cost only, never the pairs.
What the walk finds must also agree in a second fingerprint, within BOTH bits of the two, so that documents which share a shingle
and no more don't string together into clusters that outgrow the corpus. A root with over NODE documents is not walked: its fingerprints are compared in blocks.

What met is verified on whole sets: components of the candidates are cut into blocks of bounded size, a task compares
one pair of blocks, and only a forest of the links leaves it. Documents with equal sets are one class from the start.

Words are those of SimHash, shingles are 64-bit hashes. Defined cases: a text with fewer words than a shingle is one
shingle; texts without words (null, empty) are one class; equal doc_ids are rows of their own; a null doc_id is kept
only in a component that has no other; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace, free_name, gather, lower_ascii, mix64, narrow, pieces, text_bytes, word_spans
from wardflow.llm.simhash import components, forest, walk

WORDS = 5
THRESHOLD = 0.8
#: Differing bits of 64 beyond which a pair isn't verified; at 0.8 the mean is 9.7 and one pair in 3,000 has more than 20.
BUDGET = 20
#: Differing bits of the 128 of both fingerprints beyond which a pair isn't verified: at 0.8 the mean is 19.4, so about one pair in 10^6 is lost by it; of unlike ones 64.
BOTH = 40
#: Documents under one shingle beyond which their fingerprints are compared in blocks instead of a walk; fingerprints compared at once.
NODE = 64
COMPARED = 2_000_000
#: Shingles of a block of a cluster, about; members from which a block's pairs are counted by a matrix product.
BLOCK_SHINGLES = 200_000
MANY = 24
#: Documents, about, whose shingles are counted for the order; how many of them make a shingle common; most common ones.
COUNTED = 20_000
COMMON = 4
MOST_COMMON = 1_000_000


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    raw, off = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, before = word_spans(raw, off)
    coded = gather(raw, starts, ends).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = known[np.asarray(coded.indices)] if len(known) else np.zeros(0, np.uint64)
    first, counts = before[:-1], np.diff(before)
    whole, h = np.zeros(len(counts), np.uint64), mix64(word)
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        whole[short] = h[first[short]]
        h = mix64(h[: max(len(word) - k, 0)] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    out = []
    for i, (lo, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        some = h[lo : lo + n - size + 1] if n >= size else whole[i : i + min(n, 1)]
        out.append(np.unique(some.view(np.int64)))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The 64-bit SimHash of a set, signed."""
    if not len(shingles):
        return 0
    ones = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def second_fingerprint(shingles: np.ndarray) -> int:
    """A 64-bit SimHash that doesn't depend on the first."""
    return fingerprint(mix64(shingles.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)).view(np.int64)) if len(shingles) else 0


def prefix_size(n: int, threshold: float = THRESHOLD) -> int:
    return n - int(np.ceil(n * threshold - 1e-9)) + 1 if n else 0


def _list(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _mapped(rows: DataFrame, made, schema: str) -> DataFrame:
    """rows (id, text) through made(ids, shingle sets), in small pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                yield made(piece.column("id"), shingle_sets(piece.column("text")))

    return rows.select("id", "text").mapInArrow(run, schema)


def _sets(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _list(sets)], ["id", "h"])


def common_shingles(rows: DataFrame, counted: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that many documents of a part of the corpus hold, and the power of two of their number."""
    every = max(1, -(-rows.count() // counted))
    some = _mapped(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), _sets, "id long, h array<long>")
    found = some.select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = found["h"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(n[order]).astype(np.int64)


def marks(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """id, set (a digest of the shingle set), n (its size), fp and fp2 (its fingerprints), prefix (hashes) of rows (id, text)."""
    known = rows.sparkSession.sparkContext.broadcast(common)

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        common, levels = known.value
        prefixes = []
        for s in sets:
            rank = np.zeros(len(s), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rank = np.where(common[at] == s, levels[at], 0)
            prefixes.append(s[np.lexsort((s, rank))][: prefix_size(len(s), threshold)].tobytes())
        out = {"id": ids, "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array([fingerprint(s) for s in sets], pa.int64()), "fp2": pa.array([second_fingerprint(s) for s in sets], pa.int64()), "prefix": pa.array(prefixes, pa.binary())}
        return pa.RecordBatch.from_pydict(out)

    return _mapped(rows, made, "id long, set binary, n long, fp long, fp2 long, prefix binary")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (x, id, fp, fp2) for each prefix shingle x."""
    for batch in batches:
        x = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        sizes = [len(v) for v in x]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)), *[pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("id", "fp", "fp2")]], ["x", "id", "fp", "fp2"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def compared(fp: np.ndarray, fp2: np.ndarray, both: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of documents of one root that differ in no more than `both` bits. Those near one document are tied by it and aren't compared
    with each other; every other document is compared with all."""

    def near(i: np.ndarray) -> np.ndarray:
        return _apart(fp[i, None], fp[None, :]) + _apart(fp2[i, None], fp2[None, :]) <= both

    some = np.unique(np.linspace(0, len(fp) - 1, 8).astype(np.int64))
    ties = near(some)
    lead = int(ties.sum(axis=1).argmax())
    tied, rest = np.flatnonzero(ties[lead]), np.flatnonzero(~ties[lead])
    left, right = [np.full(len(tied), some[lead])], [tied]
    step = max(1, COMPARED // len(fp))
    for lo in range(0, len(rest), step):
        a, b = np.nonzero(near(rest[lo : lo + step]))
        a = rest[lo + a]
        a, b = forest(a[a != b], b[a != b]) if len(a) else (a, b)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _met(budget: int, node: int, both: int = BOTH):
    """From rows (x, id, fp, fp2) in the order of x: a forest (a, b) of candidate edges, found by a trie walk under each x, or in
    blocks beyond `node`."""

    def edges(x: np.ndarray, ids: np.ndarray, fps: np.ndarray, fps2: np.ndarray) -> np.ndarray:
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
        sizes = np.diff(cut)
        group = np.repeat(np.arange(len(sizes)), sizes)
        some = (sizes[group] > 1) & (sizes[group] <= node)
        g, i, f, f2 = group[some], ids[some], fps[some].view(np.uint64), fps2[some].view(np.uint64)
        order = np.lexsort((f, g))
        g, i, f, f2 = g[order], i[order], f[order], f2[order]
        left, right = walk(g, f, budget)
        near = _apart(f[left], f[right]) + _apart(f2[left], f2[right]) <= both
        out = [np.stack((i[left[near]], i[right[near]]), 1)]
        for k in np.flatnonzero(sizes > node):
            at = slice(cut[k], cut[k + 1])
            a, b = compared(fps[at].view(np.uint64), fps2[at].view(np.uint64), both)
            out.append(np.stack((ids[at][a], ids[at][b]), 1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("x", "id", "fp", "fp2")
        held, parts, rows = [np.zeros(0, np.int64)] * len(columns), [], 0

        def out(e: np.ndarray) -> pa.RecordBatch:
            # who meets whom is asked again within clusters, so a forest of the edges is enough here
            a, b = forest(e[:, 0], e[:, 1]) if len(e) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            parts.append([batch.column(c).to_numpy() for c in columns])
            rows += batch.num_rows
            if rows < max(50_000, len(held[0]) // 4):
                continue
            held, parts, rows = [np.concatenate(c) for c in zip(held, *parts, strict=True)], [], 0
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield out(edges(*(h[:last] for h in held)))
                held = [h[last:] for h in held]
        held = [np.concatenate(c) for c in zip(held, *parts, strict=True)]
        if len(held[0]):
            yield out(edges(*held))

    return run


def _verified(threshold: float):
    """From rows (cluster, i, j, block, id, h) in order of cluster, i, j: a forest (a, b) of the links between block i and block j."""
    need = threshold / (1 + threshold)

    def links(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], inside: bool) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets], np.int64)
        if len(ids) <= MANY:
            pairs = [(p, q) for p in range(len(ids)) for q in range(p) if (inside or block[p] != block[q]) and min(sizes[p], sizes[q]) >= threshold * max(sizes[p], sizes[q]) - 1e-6]
            found = [(p, q) for p, q in pairs if len(np.intersect1d(sets[p], sets[q], assume_unique=True)) >= (sizes[p] + sizes[q]) * need - 1e-6]
            a, b = (np.array(v, np.int64) for v in (zip(*found, strict=True) if found else ((), ())))
        else:
            value, at = np.unique(np.concatenate(sets), return_inverse=True)
            of = np.repeat(np.arange(len(ids)), sizes)
            shared = np.bincount(at, minlength=len(value)) > 1
            column = np.cumsum(shared) - 1
            keep = shared[at]
            at, of = column[at[keep]], of[keep]
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
            both = np.zeros((len(ids), len(ids)), np.float32)
            for lo in range(0, int(shared.sum()), 4096):
                s, e = np.searchsorted(at, (lo, lo + 4096))
                part = np.zeros((len(ids), 4096), np.float32)
                part[of[s:e], at[s:e] - lo] = 1
                both += part @ part.T
            near = both >= (sizes[:, None] + sizes[None, :]) * need - 1e-6
            if not inside:
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(np.triu(near, 1))
        return forest(ids[a], ids[b]) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, block, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            a, b = links(np.array(ids, np.int64), np.array(block, np.int64), sets, key[1] == key[2])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
            lists = batch.column("h")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r, (k, i, at) in enumerate(zip(keys, batch.column("id").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if k != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, block, sets = k, [], [], []
                ids.append(i)
                block.append(at)
                sets.append(values[offsets[r] : offsets[r + 1]].copy())
        if len(ids) > 1:
            yield done()

    return run


def similar(rows: DataFrame, known: DataFrame, space: Workspace, threshold: float = THRESHOLD, budget: int = BUDGET, node: int = NODE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(v, label): components of rows (id, text), all with different sets, linked at the threshold. known: their marks."""
    entries = known.select("id", "fp", "fp2", "prefix").mapInArrow(_entries, "x long, id long, fp long, fp2 long")
    met = space.save(entries.repartition("x").sortWithinPartitions("x").mapInArrow(_met(budget, node), "a long, b long").distinct(), "met")
    clusters = space.save(components(met, space).select(F.col("v").alias("id"), F.col("label").alias("cluster")), "clusters")
    sized = clusters.join(known.select("id", "n"), "id").groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"))
    placed = clusters.join(sized, "cluster").select("id", "cluster", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    sets = _mapped(rows.join(narrow(clusters.select("id")), "id", "left_semi"), _sets, "id long, h array<long>")
    sent = sets.join(placed, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "h")
    found = sent.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_verified(threshold), "a long, b long")
    return components(space.save(found, "alike"), space)


def one_of_each(docs: DataFrame, space: Workspace, threshold: float = THRESHOLD, counted: int = COUNTED) -> DataFrame:
    """The documents, one of each component of near copies: the row with the least doc_id."""
    id_ = free_name(docs, "row_id")
    keyed = space.save(docs.withColumn(id_, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col(id_).alias("id"), "text")
    marked = space.save(marks(rows, common_shingles(rows, counted), threshold), "marks")
    firsts = space.save(marked.groupBy("set").agg(F.min("id").alias("class"), F.max("n").alias("n")), "firsts")
    copies = marked.select("id", "set").join(firsts, "set").where("id <> class OR n = 0").select("id")
    copies = space.save(copies, "copies")
    distinct = rows.join(narrow(copies), "id", "left_anti")
    roots = similar(distinct, marked.join(narrow(copies), "id", "left_anti"), space, threshold)
    named = firsts.join(roots, F.col("class") == F.col("v"), "left").select("set", F.coalesce("label", "class").alias("root"))
    grouped = marked.select("id", "set").join(named, "set").join(keyed.select(F.col(id_).alias("id"), F.col("doc_id").alias("named")), "id")
    first = F.min(F.struct(F.col("named").isNull(), "named", "id"))
    kept = grouped.groupBy("root").agg(first["id"].alias("kept"))
    gone = space.save(grouped.join(kept, F.col("id") == F.col("kept"), "left_anti").select(F.col("id").alias(id_)), "gone")
    return keyed.join(narrow(gone), id_, "left_anti").select(*[f"`{c}`" for c in docs.columns])
