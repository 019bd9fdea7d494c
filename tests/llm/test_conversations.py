"""Conversation repair against a plain dynamic programme over whole conversations, and that against all edits of small ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wardflow.llm import conversations
from wardflow.llm._util import Workspace

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def edits_of(rows, flaws, at, state, depth=0):
    """Every (cost, audit, repaired) from row `at` on, at most one insertion before each row and at the end."""
    for role in ("", "user", "assistant") if depth < 2 else ("",):
        if role:
            for cost, audit, rest in edits_of(rows, flaws, at, state + role[0], depth + 1):
                yield cost + 5, "I" + audit, [(role, ""), *rest]
        elif at == len(rows):
            if GRAMMAR.fullmatch(state):
                yield 0, "", []
        else:
            _, was, text = rows[at]
            for letter, cost, left in [("D", 2, None)] + ([("K", 0, was), ("R", 1, "user"), ("R", 1, "assistant")] if flaws[at] not in "bd" else []):
                cost += 5 * (flaws[at] == "t" and left is not None)
                if left == "":
                    continue
                for more, audit, rest in edits_of(rows, flaws, at + 1, state + (left or "")[:1], 0):
                    yield cost + more, letter + audit, ([(left, text)] if left is not None else []) + rest


def cheapest(rows):
    """(cost, audit, repaired) by state, kept whole."""
    flaws = faults(rows)
    best = {"": (0, "", [])}

    def ahead(have):
        out = dict(have)
        for state, (cost, audit, left) in have.items():
            for role in ("user", "assistant"):
                into = step(state, role[0])
                if into:
                    out[into] = min(out.get(into, (1 << 60,)), (cost + 5, audit + "I", [*left, (role, "")]))
        return out

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    for (_, role, text), flaw in zip(rows, flaws, strict=True):
        new = {}
        for state, (cost, audit, left) in ahead(best).items():
            choices = [(state, cost + 2, "D", [])]
            if flaw not in "bd":
                extra = 5 * (flaw == "t")
                choices += [(step(state, role[:1]), cost + extra, "K", [(role, text)])]
                choices += [(step(state, r[0]), cost + extra + 1, "R", [(r, text)]) for r in ("user", "assistant")]
            for into, price, letter, add in choices:
                if into is not None:
                    new[into] = min(new.get(into, (1 << 60,)), (price, audit + letter, [*left, *add]))
        best = new
    return min(v for k, v in ahead(best).items() if k in ("", "a"))


def expected(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        flaws, turns = faults(kept), [t for t, _, _ in kept if t is not None]
        cost, audit, left = cheapest(kept)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, flaws.count("b"), flaws.count("d"), flaws.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def answer(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made(rng, n, turns):
    texts = ["Yes.", "no", "", " \n", "Why?", "ok!", None, "Größe. ", "  end.\t", "x" * 5000]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    for conv in [None, *range(n)]:
        for t in range(rng.randint(1, turns)):
            yield conv, rng.choice([t, t, t, None, t + 2, 0]), rng.choice(roles), rng.choice([*texts, f"text {t}.", f"text {t}."])


def test_dynamic_programme_is_least_of_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", ""])) for t in range(rng.randint(0, 3))]
        all_edits = list(edits_of(rows, faults(rows), 0, ""))
        cost = min(c for c, _, _ in all_edits)
        audit = min(a for c, a, _ in all_edits if c == cost)
        assert cheapest(rows)[:2] == (cost, audit)
        assert [left for c, a, left in all_edits if (c, a) == (cost, audit)][0] == cheapest(rows)[2]


def test_supplied(spark, sf, space):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert answer(conversations.repair(conversations.damage(rows), space)) == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("segment, fan", [(conversations.SEGMENT, conversations.FAN), (4, 2), (3, 5)])
def test_made(spark, segment, fan):
    rows = list(made(random.Random(segment), 60, 25))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(5)
    assert answer(conversations.repair(conversations.damage(df), Workspace(spark), segment, fan)) == expected(rows)


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice(["", ".", "."])) for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert answer(conversations.repair(conversations.damage(df), Workspace(spark), 64, 8)) == expected(rows)


def test_repaired_rows_follow_the_grammar(spark, space):
    rows = list(made(random.Random(5), 40, 12))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = defaultdict(list)
    for r in conversations.repaired_rows(conversations.damage(df), space, 4, 2).orderBy("place").collect():
        out[None if r.conv_id is None else int(r.conv_id)].append((r.role, r.text))
    for conv, kept in damaged(rows).items():
        assert out[conv] == cheapest(kept)[2]
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in out[conv]))


def test_empty_and_wholly_dropped(spark, space):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert answer(conversations.repair(conversations.damage(none), space)) == {}
    dropped = [(c, t, "user", "a.") for c in range(200) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame(dropped, none.schema)
    assert answer(conversations.repair(conversations.damage(df), space)) == expected(dropped)
