"""Packing: every piece is there once and whole, sequences are gapless, and few."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardflow.llm import packing, queries
from wardflow.llm._util import Workspace


def fit_decreasing(lengths, most):
    """Bins that the plain greedy rule needs."""
    bins = []
    for x in sorted(lengths, reverse=True):
        at = min((i for i, room in enumerate(bins) if room >= x), key=bins.__getitem__, default=None)
        if at is None:
            bins.append(most - x)
        else:
            bins[at] -= x
    return len(bins)


def fewest(lengths, most):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, most - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_each_length_once_and_are_few(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), rng.integers(1, 60, 3000), np.full(5000, 700), rng.choice([1, 1024, 1025, 2048, 683], 4000), np.minimum(2048, rng.lognormal(5, 1.2, 6000).astype(int) + 1), np.ones(5000, int)][seed]
    bins = packing.best_two_fit(lengths)
    assert Counter(x for b in bins for x in b) == Counter(lengths.tolist())
    assert max(map(sum, bins)) <= packing.SEQUENCE
    assert len(bins) <= 1.01 * fit_decreasing(lengths.tolist(), 2048)
    bound = -(-int(lengths.sum()) // 2048)
    if seed in (1, 4, 5):
        assert len(bins) <= bound + 1


def test_close_to_the_least_number_of_small_cases():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        assert len(packing.best_two_fit(np.array(lengths), 20)) <= fewest(lengths, 20) + 1


def test_two_documents_replace_the_smallest():
    # greedy: 60 30 leaves 10; 30 gives way to 25 and 15
    assert sorted(packing.best_two_fit(np.array([60, 30, 25, 15]), 100), key=len) == [[30], [60, 25, 15]]


def test_cut():
    doc, piece, start, length = packing.cut(np.array([1, 2048, 2049, 5000]))
    assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == [(0, 0, 0, 1), (1, 0, 0, 2048), (2, 0, 0, 1), (2, 1, 1, 2048), (3, 0, 0, 904), (3, 1, 904, 2048), (3, 2, 2952, 2048)]


@pytest.mark.parametrize("which, shard", [("supplied", packing.SHARD_PIECES), ("supplied", 40), ("tricky", 5)])
def test_query_against_the_tokenizer(spark, sf, tricky, which, shard):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "supplied" else tricky
    tokenizer, want = Tokenizer.from_file(queries.tokenizer_file()), Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if not start else start + 2048]
            want[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(docs, queries.tokenizer_file(), Workspace(spark), shard).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 2048
    shards = max(1, round(len(got) / shard))
    assert len(held) <= -(-sum(r.length for r in got) // 2048) + 2 * shards


def test_sequences_hold_the_ids(spark, tricky, space):
    got = packing.sequences(tricky, queries.tokenizer_file(), space, most=64).collect()
    pieces = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.pack(tricky, queries.tokenizer_file(), Workspace(spark), most=64).collect()}
    assert sum(len(r.pieces) for r in got) == len(pieces)
    crcs = Counter(zlib.crc32(r.ids[4 * p.offset : 4 * (p.offset + p.length)]) for r in got for p in r.pieces)
    assert crcs == Counter(pieces.values())


def test_no_rows(no_rows, space):
    assert packing.pack(no_rows, queries.tokenizer_file(), space).count() == 0
