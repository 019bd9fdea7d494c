"""Collocations against plain counting, and the automaton against end positions worked out one by one."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardflow.llm import collocations
from wardflow.llm._util import Workspace


def expected(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {(q[i : i + k], a) for q, a in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)}
        found = []
        for p, a in often.items():
            if (p, a) in inside:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_automaton(depth):
    rng = np.random.default_rng(depth)
    for size, letters in ((0, 3), (1, 1), (40, 2), (300, 3), (300, 12)):
        symbols = rng.integers(0, letters + 1, size) * (rng.random(size) > 0.1)
        ends = defaultdict(set)
        for e in range(size):
            for k in range(1, depth + 1):
                part = tuple(symbols[e - k + 1 : e + 1].tolist()) if e - k + 1 >= 0 else (0,)
                if 0 in part:
                    break
                ends[part].add(e)
        classes = defaultdict(list)
        for part, where in ends.items():
            classes[frozenset(where)].append(part)
        a = collocations.SuffixAutomaton(symbols, depth)
        spell = lambda end, k: tuple(symbols[end - k + 1 : end + 1].tolist())
        state = {spell(e, k): i for i, (e, k) in enumerate(zip(a.end, a.length, strict=True))}
        # equal end positions put phrases in one class if one is the other's suffix, which in a bounded automaton all of one class are
        assert set(state) == {max(parts, key=len) for parts in classes.values()}
        for where, parts in classes.items():
            i = state[max(parts, key=len)]
            assert a.endpos[i] == len(where) and a.shortest[i] == min(map(len, parts))
            link = min(parts, key=len)[1:]
            assert a.link[i] == (state[max(classes[frozenset(ends[link])], key=len)] if link else -1)
        got = [(spell(e, k), c) for e, k, c in zip(*a.phrases(1), strict=True)]
        assert len(got) == len(ends) and dict(got) == {p: len(x) for p, x in ends.items()}


@pytest.mark.parametrize("least, top, chunk", [(3, 2000, 1 << 20), (2, 50, 3000), (5, 2000, 400)])
def test_supplied_and_tricky(spark, sf, tricky, least, top, chunk):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0").select("lang", "text").collect()] + [tuple(r) for r in tricky.select("lang", "text").collect()]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert answer(collocations.collocations(docs, Workspace(spark), least, top, chunk)) == expected(rows, least, top)


def test_pieces_case_ties_and_overlaps(spark, space):
    rows = [("en", "A a a a. a A\ta\vb c! b c; B C"), (None, "B c, É é É é"), ("und", "b\x85c b c b c"), ("en", None), ("en", ""), ("en", "b c d e f g h " * 4), ("de", "x y " * 7)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert answer(collocations.collocations(docs, space, 2, 2000)) == expected(rows, 2, 2000)


def test_products_beyond_64_bits(spark, space, monkeypatch):
    counts = [("en", "x", 1, 9 * 10**12), ("en", "y", 1, 7 * 10**12), ("en", "x y", 2, 6 * 10**12)]
    known = spark.createDataFrame(counts, "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (known, totals))
    assert answer(collocations.collocations(known, space)) == [("en", 1, "x y", 6 * 10**12, 9 * 10**12, 7 * 10**12, 9 * 10**13, 1000 * 6 * 9 * 10**25 // (63 * 10**24))]


def test_no_rows(no_rows, space):
    assert collocations.collocations(no_rows, space).collect() == []
