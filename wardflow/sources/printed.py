"""Printed notes: RTF, DOCX and plain text files to their text, one row a file, with issues.

Files come as bytes (Spark's binaryFile source), so a folder of them is spread over tasks by size; each file is read where it lies, and what
it says goes on as rows of lines, notes and parts.

Defined cases: what a file is follows from its first bytes, not its name; a file beyond `most_bytes`, packed or unpacked, gets TOO_LONG and no
text; one that is damaged NOT_READABLE; a PDF NOT_SUPPORTED; one without a letter or digit NO_TEXT; a null file NOT_READABLE.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.episodes import read_text_notes
from wardflow.sources.tables import table

MOST_BYTES = 20_000_000
# RTF words that stand for a character, and groups whose content isn't text.
SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": "\u2003", "enspace": "\u2002"}
NO_TEXT_GROUPS = set("fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote listtable listoverridetable rsidtbl generator themedata datastore xmlnstbl filetbl revtbl fldinst".split())
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


class TooLong(ValueError):
    pass


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: a stack of groups, each with its code page, its skip after a Unicode character, and whether it is text."""
    source = data.decode("latin-1")
    out: list[str] = []
    page, skip, text = "cp1252", 1, True
    stack: list[tuple[str, int, bool]] = []
    left = 0  # stand-ins after a Unicode character that are still to be left out
    first = False  # whether a group has just begun
    high = 0
    for m in _TOKEN.finditer(source):
        word, number, byte, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((page, skip, text))
            first, left = True, 0
            continue
        if brace == "}":
            if not stack:
                raise ValueError("a group ends that never began")
            page, skip, text = stack.pop()
            first, left = False, 0
            continue
        if word:
            if word in NO_TEXT_GROUPS and first:
                text = False
            elif word == "ansicpg" and number:
                page = _page(int(number))
            elif word in ("mac", "pc", "pca"):
                page = {"mac": "mac_roman", "pc": "cp437", "pca": "cp850"}[word]
            elif word == "uc":
                skip = int(number or 1)
            elif word == "u" and number:
                code = int(number) % 65536
                if 0xD800 <= code < 0xDC00:
                    high = code
                elif text:
                    out.append(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00) if high and 0xDC00 <= code < 0xE000 else "\ufffd" if 0xD800 <= code < 0xE000 else chr(code))
                    high = 0
                left = skip
            elif word in SIGNS and text:
                if left:
                    left -= 1
                else:
                    out.append(SIGNS[word])
        elif byte:
            if left:
                left -= 1
            elif text:
                out.append(bytes([int(byte, 16)]).decode(page, "replace"))
        elif sign:
            if sign == "*":
                text = False
            elif left:
                left -= 1
            elif text:
                out.append({"~": "\xa0", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign if sign in "\\{}" else ""))
        elif plain:
            shown = plain[left:]
            left = max(0, left - len(plain))
            if text:
                out.append(shown.encode("latin-1").decode(page, "replace"))
        first = False
    if stack:
        raise ValueError("a group never ends")
    return "".join(out)


def _page(number: int) -> str:
    try:
        return codecs.lookup(f"cp{number}").name
    except LookupError:
        return "cp1252"


def docx_text(data: bytes, most_bytes: int) -> str:
    """The text of a DOCX file: a line for each paragraph, with tabs and breaks in it, in the order of the document; tables by row and cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > most_bytes:
            raise TooLong
        out: list[str] = []
        hidden = 0
        with archive.open("word/document.xml") as xml:
            for event, node in ElementTree.iterparse(xml, ("start", "end")):
                tag = node.tag.removeprefix(_W)
                if tag in ("del", "instrText"):  # what was deleted, and codes of fields
                    hidden += 1 if event == "start" else -1
                elif event == "end" and not hidden:
                    if tag == "t":
                        out.append(node.text or "")
                    elif tag in ("tab", "br", "cr", "p"):
                        out.append("\t" if tag == "tab" else "\n")
                if event == "end":
                    node.clear()
    return "".join(out)


def plain_text(data: bytes) -> str:
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _read(data: bytes | None, most_bytes: int) -> tuple[str | None, str | None, str | None]:
    """(kind, text, issue) of a file."""
    if data is None:
        return None, None, "NOT_READABLE"
    kind = "rtf" if data[:5] == b"{\\rtf" else "docx" if data[:4] == b"PK\x03\x04" else "pdf" if data[:4] == b"%PDF" else "text"
    if kind == "pdf":
        return kind, None, "NOT_SUPPORTED"
    try:
        if len(data) > most_bytes:
            raise TooLong
        text = rtf_text(data) if kind == "rtf" else docx_text(data, most_bytes) if kind == "docx" else plain_text(data)
    except TooLong:
        return kind, None, "TOO_LONG"
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError):
        return kind, None, "NOT_READABLE"
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").strip("\n")
    return (kind, text, None) if re.search(r"\w", text) else (kind, None, "NO_TEXT")


def read_printed(files: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """From (key, content as bytes): key, kind (rtf, docx, pdf, text), text, issue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: files may be long
                kind, text, issue = _read(batch.column("content")[i].as_py(), most_bytes)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, 1), *[pa.array([x], pa.string()) for x in (kind, text, issue)]], [key, "kind", "text", "issue"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, kind string, text string, issue string")


# ---- notes of suppliers, written as files of three kinds by tasks, and read again ----

_LINES = "03/04/2026 Initial — Dr Li|S: knee “pain” {k}\tleft|worse at night|O: full range; café 50% {{ok}}|P: rest \\ ice|2026-04-05|seen briefly"


def to_rtf(text: str) -> bytes:
    """A plain text as RTF: control signs escaped, characters beyond ASCII by code page or number."""
    body = re.sub(r"[\\{}]", r"\\\g<0>", text)
    coded = "".join(c if c < "\x80" else f"\\'{c.encode('cp1252').hex()}" if c == "é" else f"\\u{ord(c)}?" for c in body)
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator Made;}\\f0 " + coded.replace("\t", "\\tab ").replace("\n", "\\par\n") + "}").encode("ascii")


def to_docx(text: str) -> bytes:
    """A plain text as DOCX, one paragraph a line, its runs cut in the middle."""
    from xml.sax.saxutils import escape

    run = lambda s: "<w:r><w:tab/></w:r>".join(f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>' for x in s.split("\t"))
    body = "".join(f"<w:p>{run(line[: len(line) // 2])}{run(line[len(line) // 2 :])}</w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


_TEXT_SQL = "replace(replace('" + _LINES.format(k="#").replace("|", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "', '#', CAST(s_suppkey AS VARCHAR(9))), '@', s_name)"
_KIND_SQL = "CASE s_suppkey % 4 WHEN 0 THEN 'rtf' WHEN 1 THEN 'docx' WHEN 2 THEN 'text' ELSE 'pdf' END"


@query(f"""WITH f AS (SELECT s_suppkey AS k, {_KIND_SQL} AS kind, {_TEXT_SQL} AS text FROM supplier)
SELECT k, kind, CASE WHEN kind <> 'pdf' THEN md5(text) END AS text_md5, CASE WHEN kind = 'pdf' THEN 'NOT_SUPPORTED' END AS issue FROM f""")
def printed_texts(spark, sf_dir):
    """Texts of files that tasks have written as RTF, DOCX, plain text and, so that it is refused, PDF."""
    read = read_printed(_files(spark, sf_dir), "k")
    return read.select("k", "kind", F.md5("text").alias("text_md5"), "issue")


@query("""SELECT s_suppkey AS k, 0 AS n, DATE '2026-04-03' AS day, 'knee “pain” ' || s_suppkey || chr(9) || 'left worse at night' AS subjective, 'rest \\ ice' AS plan FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL SELECT s_suppkey, 1, DATE '2026-04-05', '', '' FROM supplier WHERE s_suppkey % 4 <> 3""")
def printed_notes(spark, sf_dir):
    """Notes in those files."""
    read = read_printed(_files(spark, sf_dir), "k").where("text IS NOT NULL").select("k", F.col("text").alias("content"))
    return read_text_notes(read, "k").select("k", "n", "day", "subjective", "plan")


def _files(spark, sf_dir) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = {"rtf": to_rtf, "docx": to_docx, "text": str.encode, "pdf": lambda _: b"%PDF-1.7"}
        for batch in batches:
            made = [make[kind](text) for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(made, pa.binary())], ["k", "content"])

    k = F.col("s_suppkey")
    lines = F.replace(F.lit(_LINES.format(k="#").replace("|", "\n")), F.lit("#"), k.cast("string"))
    kind = F.when(k % 4 == 0, "rtf").when(k % 4 == 1, "docx").when(k % 4 == 2, "text").otherwise("pdf")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), kind.alias("kind"), lines.alias("text")).mapInArrow(write, "k long, content binary")
