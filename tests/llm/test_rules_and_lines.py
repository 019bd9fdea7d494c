"""Line dedup on rows of every kind, the learner of quality rules against a plain one, long texts in SimHash, ids at the edge."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_against_brute_force import fingerprint

from wardflow.llm import line_dedup, lm_scoring, quality_rules, simhash
from wardflow.llm._util import Workspace


def plain_lines(html):
    text = re.sub(line_dedup.INLINE, "", html or "")
    return [x.strip(" ") for x in re.split(line_dedup.BREAK, text) if x.strip(" ")]


def plain_dedup(rows):
    host = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "") or [None, ""])[1].lower()
    pages, held = Counter(host(u) for _, u, _ in rows), defaultdict(Counter)
    for _, u, h in rows:
        held[host(u)].update(set(plain_lines(h)))
    out = Counter()
    for i, u, h in rows:
        lines = plain_lines(h)
        gone = lambda x, u=u: held[host(u)][x] >= line_dedup.MIN_PAGES and held[host(u)][x] > line_dedup.RATIO * pages[host(u)]
        keep = [x for x in lines if not gone(x)]
        out[i, host(u), pages[host(u)], len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    return out


ROWS = [
    *[(i, "https://Big.example.com/a", f"<p>Menu</p><p>page {i}</p><p>Footer <b>bold</b></p>") for i in range(40)],
    *[(100 + i, "https://small.example.com", "<p>Menu</p>") for i in range(2)],
    (200, None, "<p>no url</p>"), (201, "not a url", "<p>no url</p>"), (202, "", None), (203, "https://big.example.com/x", ""),
    (204, "https://u:p@big.example.com:80/q", "Menu\nMenu\r\nother"), (None, "https://big.example.com/", "<p>Menu</p>"),
    (5, "https://Big.example.com/a", "<p>Menu</p><p>page 5</p><p>Footer <b>bold</b></p>"),
    *[(300 + i, "https://tie.example.com", f"<p>{'often' if i < 3 else 'x'}</p>") for i in range(10)],
    (400, "https://long.example.com", "<p>" + "</p><p>".join(f"line {i % 5000}" for i in range(30_000)) + "</p>"),
]


@pytest.mark.parametrize("part", [line_dedup.HOST_PART, 7])
def test_line_dedup_on_every_kind_of_row(part, spark, space, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOST_PART", part)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    clashing = pages.withColumns({c: F.lit("x") for c in ("host", "lines", "salt", "parts", "key", "drop", "kept", "text", "host_pages")})
    for table in (pages, clashing):
        got = line_dedup.drop_boilerplate(table, Workspace(spark)).collect()
        assert Counter((r.page_id, r.host, r.host_pages, r.n_lines, r.n_dropped, r.text) for r in got) == plain_dedup(ROWS)


def test_line_dedup_of_supplied_pages_and_of_none(spark, sf, space):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = line_dedup.drop_boilerplate(pages, space).collect()
    assert Counter((r.page_id, r.host, r.host_pages, r.n_lines, r.n_dropped, r.text) for r in got) == plain_dedup([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert line_dedup.drop_boilerplate(pages.limit(0), Workspace(spark)).count() == 0


def _stats(n, seed):
    """Rows of statistics; bad are those with long words and many symbols, or with many digits."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = 100
        chars, symbols, digits = rng.randrange(300, 901), rng.randrange(0, 41), rng.randrange(0, 200)
        bad = chars > 600 and symbols > 20 or digits > 150
        rows.append((i, words, chars, symbols, 0, 0, 10, digits, 12, 10, 80))
        labels.append((i, int(not bad)))
    return rows, labels


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_punct long, n_lines long, n_distinct long"


def test_learner_needs_two_conditions_and_two_rules(spark, space):
    rows, labels = _stats(3_000, 1)
    rules = quality_rules.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), space)
    assert len(rules) >= 2 and max(len(r.conditions) for r in rules) >= 2
    fresh, truth = _stats(2_000, 2)
    judged = spark.createDataFrame(fresh, SCHEMA).select("doc_id", quality_rules.verdict(rules).alias("rule")).collect()
    good = dict(truth)
    assert sum((r.rule == 0) == bool(good[r.doc_id]) for r in judged) / len(judged) > 0.93


def test_first_condition_has_the_best_gain(spark, space):
    """No single test of any feature at any value has more than a little more gain than the first condition on the rows it grew on."""
    rows, labels = _stats(3_000, 3)
    stats = spark.createDataFrame(rows, SCHEMA)
    rules = quality_rules.learn(stats, spark.createDataFrame(labels, "doc_id long, quality int"), space)
    grow = stats.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) != 0).select("doc_id", *[c.alias(n) for n, c in quality_rules.features().items()]).collect()
    bad = {i for i, q in labels if q == 0}
    p0, n0 = sum(r.doc_id in bad for r in grow), sum(r.doc_id not in bad for r in grow)

    def gain(p, n):
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

    best = 0.0
    for f in quality_rules.FEATURES:
        p = n = 0
        ordered = sorted((r[f], r.doc_id in bad) for r in grow)
        for k, (v, b) in enumerate(ordered):
            p, n = p + b, n + (not b)
            if k + 1 == len(ordered) or ordered[k + 1][0] > v:
                best = max(best, gain(p, n), gain(p0 - p, n0 - n))
    name, above, value = rules[0].conditions[0]
    hit = [r.doc_id in bad for r in grow if (r[name] > value) == above]
    assert gain(sum(hit), len(hit) - sum(hit)) >= 0.9 * best


def test_no_rule_where_nothing_tells_good_from_bad(spark, space):
    rng = random.Random(4)
    rows, _ = _stats(600, 5)
    labels = [(r[0], rng.randrange(2)) for r in rows]
    rules = quality_rules.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), space)
    assert len(rules) <= 1  # nothing that holds at a precision of 0.9 on rows it was not grown on, but by chance


def test_simhash_of_very_long_texts(spark, space):
    long = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (4, "\n"), (5, "short text")], "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, space).collect()}
    assert {i: f for i, (f, _) in got.items()} == {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    assert got[1][1] == got[2][1] == 1 and got[3][1] == got[4][1] == 3 and got[5][1] == 5


def test_one_of_each_keeps_the_least(spark, space):
    docs = spark.createDataFrame([(7, "a b c d e f g"), (3, "A B C D E F G"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, "something else entirely here"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(docs, space).collect()]
    assert len(got) == 3 and (9, "something else entirely here") in got and (None, None) in got and [i for i, _ in got].count(3) == 1


def test_the_largest_id_is_not_a_missing_one(spark, space):
    top = 2**63 - 1
    docs = spark.createDataFrame([(top, "one two"), (None, "one two"), (1, "one two three")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, space).collect()}
    assert set(got) == {top, None, 1} and got[top].n_tokens == got[None].n_tokens == 3
