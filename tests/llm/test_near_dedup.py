"""The near-dedup stage of the pipeline against a plain version and on planted near copies."""

import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from wardflow.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def components(sets):
    """Root of each place of a list of sets: linked at a Jaccard similarity of 0.8; empty sets are alike."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def kept(rows):
    groups = {}
    for r, root in zip(rows, components([shingles(r.text) for r in rows]), strict=True):
        groups.setdefault(root, []).append((r.doc_id is None, r.doc_id or 0))
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("table", ["supplied", "tricky"])
def test_against_plain_version(table, spark, sf, tricky):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if table == "supplied" else tricky
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == kept(docs.select("doc_id", "text").collect())


@pytest.fixture
def planted():
    """Texts of 60 to 400 words with copies in which one word of each 60 differs, and others in which every tenth does."""
    rng, rows = random.Random(3), []
    for k in range(60):
        w = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice((60, 120, 400)))]
        near = [f"new{k}" if i % 60 == 30 else x for i, x in enumerate(w)]
        far = [f"other{k}" if i % 10 == 5 else x for i, x in enumerate(w)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
    return rows


def test_planted_near_copies(planted, spark, sf):
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(planted, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for k in range(60) for i in (10 * k, 10 * k + 2))


@pytest.mark.parametrize("node, block_shingles", [(near_dedup.NODE, near_dedup.BLOCK_SHINGLES), (2, 900)])
def test_roots_clusters_and_blocks_lose_no_link(planted, spark, space, monkeypatch, node, block_shingles):
    """Common shingles, an order from a small part of the texts, clusters without a walk and many blocks change the work but not the components."""
    monkeypatch.setattr(near_dedup, "COMMON", 1)
    shared = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{text} {shared}") for i, text in planted]
    base = planted[6][1].split()
    rows += [(10_000 + k, " ".join(f"v{k}" if i in (k, k + 60) else w for i, w in enumerate(base))) for k in range(50)]
    sets = [shingles(t) for _, t in rows]
    want, least = components(sets), {}
    for (i, _), root in zip(rows, want, strict=True):
        least[root] = min(least.get(root, i), i)
    df = spark.createDataFrame(rows, "id long, text string")
    got = near_dedup.similar(df, near_dedup.marks(df, near_dedup.common_shingles(df, 40)), space, node=node, block_shingles=block_shingles)
    labels = {r.v: r.label for r in got.collect()}
    assert {i: labels.get(i, i) for i, _ in rows} == {i: least[root] for (i, _), root in zip(rows, want, strict=True)}
    assert len(set(want)) < len(rows) - 60


def test_documents_that_share_a_shingle_only_make_no_cluster(spark):
    """300 unlike documents under one root, two near copies among them: one edge, not a star of all."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(299)]
    texts.append(texts[5] + " more")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = near_dedup.marks(rows, near_dedup.common_shingles(rows)).select("id", "fp", "fp2").toPandas()
    batch = pa.RecordBatch.from_pydict({"x": pa.array([1] * 300, pa.int64()), **{c: pa.array(known[c]) for c in known}})
    for node in (near_dedup.NODE, 1_000):
        out = [b.to_pydict() for b in near_dedup._met(near_dedup.BUDGET, node)(iter([batch]))]
        assert [set(e) for b in out for e in zip(b["a"], b["b"])] == [{5, 299}]
