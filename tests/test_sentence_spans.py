"""Sentence spans: cases by hand, properties of generated texts, and time in proportion to a line's length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from wardflow.operators import sentence_spans
from wardflow.operators.sentence_spans import BLANK, paired, spans

CASES = [
    ("prose", "Dr. Li came. She left.", ["Dr. Li came.", "She left."]),
    ("prose", "It was 8.0 cm. See no. 5 and e.g. this. Done!", ["It was 8.0 cm.", "See no. 5 and e.g. this.", "Done!"]),
    ("prose", "J. T. Ellis said so. ok", ["J. T. Ellis said so. ok"]),
    ("prose", "Bends to 38° R. Then L. Shift is seen.", ["Bends to 38° R.", "Then L.", "Shift is seen."]),
    ("prose", "1. Walk. Rest", ["1. Walk.", "Rest"]),
    ("prose", "He went home:\n1. Bridges 2. Clams. 3. Planks", ["He went home:", "1. Bridges 2. Clams. 3. Planks"]),
    ("prose", "Plan: 1. Walk far. 2. Rest well. Then stop.", ["Plan: 1. Walk far. 2. Rest well.", "Then stop."]),
    ("prose", "Sites: a. Hip pain b. Knee pain. Both ease.", ["Sites: a. Hip pain b. Knee pain.", "Both ease."]),
    ("prose", "Seen on 4 Sept. 2026 at 10.30am. No. of visits: 6.", ["Seen on 4 Sept. 2026 at 10.30am.", "No. of visits: 6."]),
    ("prose", "Any falls: no. He walks.", ["Any falls: no.", "He walks."]),
    ("prose", 'He said "It hurts. A lot." Then he left', ['He said "It hurts. A lot."', "Then he left"]),
    ("prose", "Advice (Rest. Ice.) 3 visits follow. (Done.) He left.", ["Advice (Rest. Ice.) 3 visits follow.", "(Done.)", "He left."]),
    ("prose", "One ( is open. It guards nothing.", ["One ( is open.", "It guards nothing."]),
    ("prose", "Tom’s knee. It’s sore. ‘Quoted. Words’ stay.", ["Tom’s knee.", "It’s sore.", "‘Quoted. Words’ stay."]),
    ("prose", "From 5 … 7 later. It eased... then went... Gone", ["From 5 … 7 later.", "It eased... then went...", "Gone"]),
    ("prose", "Neck pain • Back pain • Hip", ["Neck pain", "• Back pain", "• Hip"]),
    ("prose", "a\n  \nB", ["a", "B"]),
    ("prose", "This line\ngoes on. Next\nLine", ["This line\ngoes on.", "Next", "Line"]),
    ("prose", "Aims:\nwalk\n- run\n2) swim", ["Aims:", "walk", "- run", "2) swim"]),
    ("prose", "Ask Dr.\nElm. Good?  £5 fee", ["Ask Dr.\nElm.", "Good?", "£5 fee"]),
    ("notes", "pain at rest. prev injury, gone. gym 2x/wk.", ["pain at rest.", "prev injury, gone.", "gym 2x/wk."]),
    ("notes", "pt. reports ache\nat 9 a.m. on days", ["pt. reports ache", "at 9 a.m. on days"]),
    ("prose", "", []),
    ("prose", " \n ", []),
    ("prose", None, []),
]


@pytest.mark.parametrize("policy, text, want", CASES)
def test_cases(policy, text, want):
    assert [text[a:b] for a, b, _, _ in spans(text, policy)] == want


def test_marks_and_words():
    text = "Aims:\n- run 2 km\n  2) swim • rest"
    assert [(text[body:b], mark) for _, b, body, mark in spans(text)] == [("Aims:", None), ("run 2 km", "-"), ("swim", "2)"), ("rest", "•")]


def generated(rng):
    parts = ["Dr. Elm", "e.g.", "8.5/10", "1.", "2.", "a.", "b.", "it hurts", "He ran", "(", ")", '"', "“", "”", "'", "Tom’s", "• Hip", "...", "…", "?", "!", ".", ":", "\n", "\n\n", "- item", "J.R. Fox", "No.", "5", "Sept. 2026", "éa", "Éa", "  ", "　", "08.09.2026", "52.3 to 29.5"]
    return "".join(rng.choice(parts) + rng.choice([" ", " ", "", ". ", "\n"]) for _ in range(rng.randint(0, 40)))


def outer_pairs(text):
    """Pairs found by looking back from each closing mark, line by line."""
    found, at = [], 0
    for line in text.split("\n"):
        open_ = []
        for i, c in enumerate(line):
            before, after = line[i - 1 : i], line[i + 1 : i + 2]
            blank = lambda x: x == "" or x in " \t\n\r\v\f　 "
            word = after.isalpha() or after.isdigit()
            leads = blank(before) or before in "\"“‘'([{-–—/"
            if c in "([{“" or (c == "‘" and not blank(after)):
                open_.append(({"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’"}[c], i))
                continue
            has = any(k == c for k, _ in open_)
            if c in "\"'" and not has:
                if leads and (word if c == "'" else not blank(after)):
                    open_.append((c, i))
                continue
            if not has or (c in "’'" and word) or (c == "'" and blank(before)):
                continue
            while open_:
                kind, start = open_.pop()
                if kind == c:
                    found.append((at + start, at + i))
                    break
        at += len(line) + 1
    return {p for a, b in found for p in range(a + 1, b + 1)}


@pytest.mark.parametrize("policy", ["prose", "notes"])
def test_generated_texts(policy):
    rng = random.Random(17)
    blank = re.compile(f"[{BLANK}]*")
    for _ in range(500):
        text = generated(rng)
        guarded = outer_pairs(text)
        starts, ends = paired(text)
        assert {p for a, b in zip(starts, ends, strict=True) for p in range(a + 1, b + 1)} == guarded
        found, last = spans(text, policy), 0
        for a, b, body, mark in found:
            assert last <= a < b and a <= body <= b and blank.fullmatch(text[last:a])
            assert text[a:b] == text[a:b].strip(BLANK + " ") or not blank.fullmatch(text[a])
            assert mark is None or text.startswith(mark, a)
            last = b
        assert blank.fullmatch(text[last:])
        for m in re.finditer(r"[0-9]+(?:[.,:/][0-9]+)+", text):
            assert any(a <= m.start() and m.end() <= b for a, b, _, _ in found)
        for (_, b, _, _), (a, *_) in zip(found, found[1:]):  # what ends a sentence inside a line isn't inside a pair
            assert "\n" in text[b:a] or b not in guarded


@pytest.mark.parametrize("unit", ["Word here. ", "a. ", "1. ", "(", "'a ", ".", " .", '"a. B" ', "\n", "Aims: 1. a ", "x ) ( "])
def test_one_long_line(unit):
    def took(n):
        text, began = unit * (n // len(unit)), time.process_time()
        spans(text), spans(text, "notes")
        return time.process_time() - began

    took(2_000)
    assert took(160_000) < 60 * max(took(8_000), 0.02)


def test_sentences_leave_and_gaps_are_mended(spark):
    texts = {1: " One. Two token.\n\nThree. ", 2: "A token. Rest.", 3: "All token.", 4: "Keep. Token here. Stay", 5: None, 6: "X y.\n\nToken z. W."}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    s = sentence_spans.split_sentences(rows, "doc_id")
    got = {r.doc_id: (r.sentences, r.removed, r.text) for r in sentence_spans.without(s, "doc_id", F.lower("sentence").contains("token")).collect()}
    assert got == {1: (3, 1, " One.\n\nThree. "), 2: (2, 1, "Rest."), 3: (1, 1, ""), 4: (3, 1, "Keep. Stay"), 6: (3, 1, "X y.\n\nW.")}
