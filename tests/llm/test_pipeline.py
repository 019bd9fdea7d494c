"""The pipeline's five stages over supplied and tricky rows, from what the stage before wrote: near-dedup, decontamination, the mix by source and token ids
in plain Python; the learned part of the quality stage against operator 6."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_dedup import kept as near_kept

import corpus_pipeline
from wardflow.llm import mixing, quality_rules, queries
from wardflow.llm._util import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)})
    return len(w) < 50 or 100 * again > 50 * len(w)


def plain_targets(sizes):
    """Words that the mix is to take of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            free.remove(s)
    return target


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


@pytest.mark.parametrize("which", ["supplied", "tricky"])
def test_all_stages(which, spark, sf, tricky, space):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if which == "tricky":  # long enough copies of the tricky rows, so that some pass the base rule
        more = " ".join(f"and then word{i} follows" for i in range(40))
        docs = tricky.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "text", F.lit(more))).otherwise(F.col("text")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "mixing", "token_ids"]
    steps = [space.save(docs, "input")]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(space.save(stage(spark, steps[-1], sf), name))
    given, good, single, clean, mixed, tokens = ([*s.collect()] for s in steps)
    assert all(s.columns == docs.columns for s in steps[:-1])

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules.judge(steps[0], labels, Workspace(spark)).where("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in good) == Counter(r.doc_id for r in judged)
    assert not any(base_failed(r.text) for r in good) and {key(r) for r in good} <= {key(r) for r in given}

    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single) == near_kept(good)

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    items = [s for s in (shingles(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if s]
    bad = {r.doc_id for r in single if any(len(s & shingles(words(r.text))) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert Counter(map(key, clean)) == Counter(key(r) for r in single if r.doc_id not in bad)

    summary = mixing.mix_summary(steps[3], Workspace(spark)).collect()
    taken, size = defaultdict(int), defaultdict(int)
    for r in summary:
        taken[r.doc_id] += r.taken
        size[r.doc_id] += r.size
    got, texts = defaultdict(int), defaultdict(list)
    for r in clean:
        texts[r.doc_id].append(r.text or "")
    for r in mixed:
        w = WORD.findall(r.text or "")
        got[r.doc_id] += len(w)
        pieces = [WORD.findall(t) for t in texts[r.doc_id]]
        assert any(r.text == t for t in texts[r.doc_id]) or any(not Counter(w) - Counter(p) for p in pieces)
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert all(taken[d] <= 2 * size[d] for d in taken)
    sizes, mixed_words = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed:
        mixed_words[r.source] += len(WORD.findall(r.text or ""))
    for s, target in plain_targets(sizes).items():
        block = min(mixing.BLOCK, max(1, -(-sizes[s] // mixing.LEAST_BLOCKS)))
        assert abs(mixed_words[s] - target) <= 1.5 * block, s

    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_file()), 0, Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    tokens.sort(key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens) == want and want
    assert [r.doc_id is not None and r.doc_id for r in tokens] == sorted((r.doc_id is not None and r.doc_id for r in tokens))
    for r in tokens:
        assert r.start == start
        start += r.n_tokens
    if which == "supplied":
        assert Counter(corpus_pipeline.run(spark, sf).collect()) == Counter(tokens)


def test_empty_table(spark, sf, space):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = space.save(stage(spark, docs, sf), name)
    assert docs.count() == 0
