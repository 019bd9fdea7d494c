"""Repeated sentences: what each states, pair by pair by hand, and against all pairs of generated texts."""

import itertools
import random

import pytest

from wardflow.operators import repeats

PAIRS = [
    ("Lumbar flexion was limited by 50% at rest", "At rest his lumbar flexion was limited by 50%", True),
    ("Lumbar flexion was limited by 50% at rest", "Lumbar flexion was limited by 40% at rest", False),
    ("Lumbar flexion was limited by 50% and 20 degrees", "Lumbar flexion was limited by 50% only today", False),  # one word of four differs
    ("Seen 06/05/2026 lumbar flexion was painful", "Seen 07/05/2026 lumbar flexion was painful", False),
    ("Seen 06/05/2026 lumbar flexion was painful", "He was seen with painful lumbar flexion", True),
    ("Lumbar flexion was not painful when seen", "Lumbar flexion was painful when he was seen", False),
    ("No saddle numbness, bladder function was normal", "Saddle numbness and bladder function were normal", False),
    ("There was no pain, numbness or swelling reported", "No pain, numbness or swelling was reported there", True),
    ("Full pain-free range of neck movement", "Full painful range and pain of neck movement", False),
    ("The left knee hurts when walking uphill slowly", "The right knee hurts when walking uphill slowly", False),
    ("L knee hurts when walking uphill slowly", "R knee hurts when walking uphill slowly", False),
    ("L4 level hurts when walking uphill slowly", "The level hurts when walking uphill slowly", True),
    ("Constant ache in the neck when driving", "Occasional ache in the neck when driving", False),
    ("At discharge lumbar flexion stayed limited overall", "Initially lumbar flexion stayed limited overall", False),
    ("Two sessions of neck exercise were done", "Three sessions of neck exercise were done", False),
    ("Four words only here", "Four words only here", False),
]


@pytest.mark.parametrize("a, b, want", PAIRS)
def test_pairs(spark, a, b, want):
    rows = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, None), (2, 0, b)], "doc long, place long, sentence string")
    assert [(r.doc, r.place, r.twin) for r in repeats.repeated_sentences_of(rows, "doc", "place").collect()] == ([(1, 1, 0)] if want else [])


def test_all_pairs_of_generated_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["neck", "pain", "left", "right", "not", "no", "and", "flexion", "walking", "50%", "06/05/2026", "discharge", "now", "mild", "severe", "stairs", "lifting", "yet", "rest,"]
    rows = [(d, p, " ".join(rng.choices(words, k=rng.randint(5, 7)))) for d in range(12) for p in range(40)]
    df = spark.createDataFrame(rows, "doc long, place long, sentence string")
    facts = {(r.doc, r.place): r for r in repeats.sentence_facts(df).collect()}

    def finding(x, y):
        few = min(len(x.content), len(y.content))
        if len(set(x.content) & set(y.content)) < 0.8 * few - 1e-9:
            return False
        if any(w in q.content and w not in q.negated for p, q in ((x, y), (y, x)) for w in p.denied):
            return False
        within = lambda a, b: all(a.count(f) <= b.count(f) for f in a)
        if not within(x.figures, y.figures) and not within(y.figures, x.figures):
            return False
        if x.times and y.times and not set(x.times) & set(y.times):
            return False
        for kind in repeats.CONTRAST:
            p, q = ({m for m in f.marks if m.startswith(kind)} for f in (x, y))
            if p and q and not (p <= q or q <= p):
                return False
        return True

    want = {}
    for (a, x), (b, y) in itertools.permutations(facts.items(), 2):
        if a[0] == b[0] and a[1] < b[1] and finding(x, y):
            want[b] = min(want.get(b, a[1]), a[1])
    got = {(r.doc, r.place): r.twin for r in repeats.repeated_sentences_of(df, "doc", "place", at=f"file://{tmp_path}/facts").collect()}
    assert got == want and want
    apart = [(x, y) for (a, x), (b, y) in itertools.combinations(facts.items(), 2) if a[0] == b[0] and len(set(x.content) & set(y.content)) >= 0.8 * min(len(x.content), len(y.content)) and not finding(x, y)]
    assert len(apart) > 20


def _generated(spark):
    rng = random.Random(8)
    words = ["neck", "pain", "left", "not", "and", "flexion", "walking", "50%", "06/05/2026", "now", "mild", "stairs", "lifting", "rest,", "aching", "shoulder"]
    rows = [(d, p, " ".join(rng.choices(words, k=rng.randint(5, 9)))) for d in (*range(4), None) for p in range(10 if d == 3 else 60)]
    return spark.createDataFrame([*rows, *((d, p + 60, x) for d, p, x in rows if p % 7 == 0)], "doc long, place long, sentence string")


def test_long_keys_meet_in_groups_of_words_and_lose_nothing(spark, tmp_path):
    df = _generated(spark)
    found = [sorted(map(tuple, repeats.repeated_sentences_of(df, "doc", "place", at=f"file://{tmp_path}/{whole}", whole=whole).collect())) for whole in (1000, 20)]
    assert found[0] == found[1] and len(found[0]) > 40 and {d for d, _, _ in found[0]} == {0, 1, 2, 3}


def test_words_are_not_shuffled(spark, tmp_path):
    """What is shuffled are digests, bitmaps and what passes the sieve, however many words the sentences have."""
    out = repeats.repeated_sentences_of(_generated(spark), "doc", "place", at=f"file://{tmp_path}/facts")
    assert "explode(content" not in out._jdf.queryExecution().toString()
    sieved = repeats._candidates(_classes(spark, [("a b c d e f g h i j", 0), ("a b c d e f g h i k", 1), ("p q r s t u v w x y z", 2)]), "doc", 0.8, 1500)
    assert [tuple(r) for r in sieved.collect()] == [(1, 0, 1)]


def _classes(spark, rows):
    df = spark.createDataFrame([(1, n, x.split()) for x, n in rows], "doc long, first long, content array<string>")
    return df.withColumns({"size": repeats.F.size("content"), "s0": repeats._signature(0), "s1": repeats._signature(1)})
