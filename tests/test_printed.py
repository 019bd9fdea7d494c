"""Printed notes: files of each kind there and back, what RTF can say, and files that are damaged or too long."""

import io
import random
import zipfile

import pytest

from wardflow.sources.printed import docx_text, read_printed, rtf_text, to_docx, to_rtf


def test_there_and_back():
    rng = random.Random(4)
    for _ in range(200):
        text = "\n".join("".join(rng.choices("ab {}\\é—“😀ß\t<&>'\"?", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 6)))
        flat = "".join(c if ord(c) < 65536 else "x" for c in text)
        assert rtf_text(to_rtf(flat)) == flat
        assert docx_text(to_docx(text), 10**6) == text + "\n"


@pytest.mark.parametrize(
    "rtf, want",
    [
        (r"{\rtf1\ansi a\'e9\'80 b}", "aé€ b"),
        (r"{\rtf1\ansi\ansicpg1250 \'b9{\ansicpg1252 \'b9}\'b9}", "ą¹ą"),
        (r"{\rtf1\uc1 x\u8212?y\uc2\u233 ??z{\uc0\u233}w}", "x—yézéw"),
        (r"{\rtf1 \u-10179?\u-8704?!}", "😀!"),
        (r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\unknown gone}{\info{\title gone}}\b bold\b0  plain\par next\tab\{x\}\\}", "bold plain\nnext\t{x}\\"),
        ("{\\rtf1 one\r\ntwo\\\nthree\\~four\\_five\\-six}", "onetwo\nthree\xa0four-fivesix"),
        (r"{\rtf1 a{\field{\*\fldinst HYPERLINK x}{\fldrslt link}}b}", "alinkb"),
    ],
)
def test_rtf(rtf, want):
    assert rtf_text(rtf.encode()) == want


def test_files_with_issues(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a>" + " " * 200_000 + "</a>")
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x.txt", "no document")
    files = {
        "rtf": to_rtf("note"), "docx": to_docx("note"), "text": b"caf\xe9", "utf16": "né".encode("utf-16"), "pdf": b"%PDF-1", "open": b"{\\rtf1 {x", "closed": b"{\\rtf1 x}}", "cut": to_docx("note")[:60], "other": other.getvalue(),
        "bomb": bomb.getvalue(), "long": b"x" * 60_000, "empty": b"", "blank": to_docx(" \n"), "none": None,
    }
    got = {r.k: (r.kind, r.text, r.issue) for r in read_printed(spark.createDataFrame(list(files.items()), "k string, content binary"), "k", 50_000).collect()}
    assert {k: v[2] for k, v in got.items()} == {
        "rtf": None, "docx": None, "text": None, "utf16": None, "pdf": "NOT_SUPPORTED", "open": "NOT_READABLE", "closed": "NOT_READABLE", "cut": "NOT_READABLE", "other": "NOT_READABLE",
        "bomb": "TOO_LONG", "long": "TOO_LONG", "empty": "NO_TEXT", "blank": "NO_TEXT", "none": "NOT_READABLE",
    }
    assert got["text"][1] == "café" and got["utf16"][1] == "né" and got["rtf"][:2] == ("rtf", "note")
