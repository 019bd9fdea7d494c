"""Printed conditions: how forms are read into trees, what stays open, and trees as columns against trees worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wardflow.operators.conditions import FORM, OPEN, Question, applies, conditions

YES = lambda q: ("is", q, "yes")
NO = lambda q: ("is", q, "no")


def read(*labels, kinds="", **more):
    """The condition of the last question of a form of these labels; kinds: y yes_no, t text, b checkbox, c choice."""
    kind = {"y": "yes_no", "t": "text", "b": "checkbox", "c": "choice"}
    form = [Question(f"q{i}", text, kind[k], **(more if i == len(labels) - 1 else {"options": more_options} if k == "c" else {})) for i, (text, k) in enumerate(zip(labels, kinds.ljust(len(labels), "t"), strict=True))]
    return conditions(form).get(f"q{len(labels) - 1}")


more_options = ("Full duties", "Light duties", "Other")


@pytest.mark.parametrize(
    "labels, kinds, want",
    [
        (("Any pain?", "If yes, describe it"), "y", YES("q0")),
        (("Any pain?", "5. If so, where"), "y", YES("q0")),
        (("Any pain?", "More care – if not, why"), "y", NO("q0")),
        (("Any pain?", "Words", "Words", "Words", "If yes, describe it"), "y", OPEN),
        (("Kind of work", "If other, which"), "c", ("is", "q0", "other")),
        (("Pain – Other", "If other, which"), "b", YES("q0")),
        (("(a) Neck?", "(b) Back?", "(c) Hip?", "(d) Knee?", "If (a), (b) or (d) is Yes, say more"), "yyyy", ("any", [YES("q0"), YES("q1"), YES("q3")])),
        (("(a) Neck?", "(b) Back?", "(c) Hip?", "If no to all of (a)–(c), say more"), "yyy", ("all", [NO("q0"), NO("q1"), NO("q2")])),
        (("(a) Neck?", "(b) Notes", "If (a) or (b) is Yes, say more"), "yt", OPEN),
        (("(a) Neck?", "(b) Back?", "If (b) to (a) is Yes, say more"), "yy", OPEN),
        (("Neck?", "Back?", "Hip?", "If yes to either question above, say more"), "yyy", ("any", [YES("q1"), YES("q2")])),
        (("Neck?", "Back?", "Hip?", "If yes to any of the above, say more"), "yyy", ("any", [YES("q0"), YES("q1"), YES("q2")])),
        (("Neck?", "Notes", "Hip?", "If no to all questions above"), "yty", ("all", [NO("q2")])),
        (("Neck?", "If yes to question 1, say more"), "y", OPEN),
        (("Neck?", "If yes, or if unsure, say more"), "y", OPEN),
        (("Neck?", "If yes, say more; if no, why?"), "y", OPEN),
        (("Has he returned to work?", "If not gone back to work, the date"), "y", OPEN),  # "gone" is in no question
        (("Has he gone back to work?", "If not gone back to work, the date"), "y", NO("q0")),
        (("Is he unable to work?", "If not able to work, why"), "y", OPEN),
        (("Is the pain worse or better?", "If the pain is worse, why"), "y", OPEN),
        (("Are home exercises advised?", "If you do not advise home exercises, why"), "y", NO("q0")),
        (("Are home exercises kept up?", "If home exercises were declined, why"), "y", OPEN),
        (("Is he working full time?", "If working, the hours"), "y", OPEN),
        (("Has he worked?", "If you have not worked, give reasons"), "y", NO("q0")),
        (("Any pain?", "If you have not worked, give reasons"), "y", OPEN),
        (("Kind of work", "If not yet on full duties, say more"), "c", ("is not", "q0", "=Full duties")),
        (("Kind of work", "If on light duties, say more"), "c", ("is", "q0", "=Light duties")),
        (("Is more treatment advised?", "Reasons for advising more treatment"), "y", YES("q0")),
        (("Pain on waking?", "Pain on waking – details"), "y", YES("q0")),
        (("Home tasks – task still limited", "Home tasks – how limited"), "t", None),
        (("Any pain?", "Where is it worst"), "y", None),
    ],
)
def test_trees(labels, kinds, want):
    assert read(*labels, kinds=kinds) == want


def test_guidance_and_headings():
    assert read("Home tasks – task still limited", "Home tasks – how limited", guidance="Only when a task is still limited.") == ("is", "q0", "filled")
    assert read("Is he on full duties?", "Main problems", kinds="y", heading="If he is not yet on full duties") == NO("q0")
    assert read("Is he on full duties?", "Main problems", kinds="y", guidance="If unsure, leave it") is None
    assert read("Any pain?", "If yes, how bad", kinds="yc") is None  # a choice prints its own way out


def holds(tree, said):
    if tree == OPEN:
        return None
    if tree[0] in ("any", "all"):
        parts = [holds(t, said) for t in tree[1]]
        if (tree[0] == "any") in parts:
            return tree[0] == "any"
        return None if None in parts else tree[0] == "all"
    how, q, wanted = tree
    value = said.get(q)
    if value is None or value.strip() == "":
        return None
    v = value.strip().lower()
    if wanted == "filled":
        return v not in ("none", "n/a")
    if wanted.startswith("="):
        hit = v == wanted[1:].lower()
    elif wanted == "other":
        hit = "other" in v
    else:
        hit = {"yes": wanted == "yes", "no": wanted == "no"}.get(v)
    return hit if how == "is" or hit is None else not hit


def test_columns_say_what_trees_say(spark):
    rng = random.Random(8)
    leaves = [("is", q, w) for q in "abc" for w in ("yes", "no", "other", "=Blue", "filled")] + [("is not", "a", "=Blue"), OPEN]

    def grow(depth):
        return rng.choice(leaves) if not depth or rng.random() < 0.3 else (rng.choice(["any", "all"]), [grow(depth - 1) for _ in range(rng.randint(1, 3))])

    trees = [grow(3) for _ in range(60)]
    said = [dict(zip("abc", x, strict=True)) for x in itertools.product(["Yes", "no", " ", None, "blue", "Other: x", "N/A"], repeat=3)]
    rows = spark.createDataFrame([(i, *s.values()) for i, s in enumerate(said)], "i int, a string, b string, c string")
    out = rows.select("i", *[applies(t, {q: F.col(q) for q in "abc"}).alias(f"t{k}") for k, t in enumerate(trees)]).collect()
    for r in out:
        for k, tree in enumerate(trees):
            assert r[f"t{k}"] == holds(tree, said[r.i]), (tree, said[r.i])


def test_the_form_of_the_query():
    assert conditions(FORM) == {"n1": ("any", [YES("q1"), YES("q2")]), "n2": ("all", [YES("q1"), YES("q2")]), "n3": NO("q2"), "n4": ("is not", "q3", "=Full duties"), "n5": ("is", "q4", "filled"), "n6": OPEN, "n7": OPEN, "n8": ("is", "q3", "other")}
