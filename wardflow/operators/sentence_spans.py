"""Sentences as spans of a text, by one pass over the places where a sentence may end.

Two policies: `prose`, where a stop before a lower-case word ends nothing and a broken line goes on, and `notes`, where both
end a sentence. Nothing is cut inside a pair of quotes or brackets that opens and closes on one line, inside numbers and dates,
after titles, short forms and initials, or between the items of a numbered list on one line. Texts are split where they lie,
in Arrow batches; what is done with the sentences is columns and windows again.

Defined cases: null and blank texts have no sentence; spans count characters; a text of one endless line takes time in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import table

# Titles, short forms inside a sentence, short forms before a number, short forms that go on in notes.
TITLES = "mr mrs ms mx dr prof rev sr st".split()
INSIDE = "e.g eg i.e ie approx appx cf viz vs incl esp nb n.b ca re wrt w.r.t aka a.k.a".split()
BEFORE_NUMBER = "no nos fig figs ref tel ext vol pp para paras sect jan feb mar apr jun jul aug sep sept oct nov dec".split()
IN_NOTES = "pt pts obs imp rx tx hx dx sx prev poss bilat lat med ant post sup inf a.m p.m".split()
# White space, what closes and opens quotes and brackets, bullets, other signs that a sentence may begin with.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CLOSING, OPENING = "\"”’')]}", "\"“‘'([{"
BULLETS, DASHES, SIGNS = "•▪◦‣", "-*–—·", "#£$€~?"

_LETTER = "A-Za-zÀ-ɏ"
#: Where a sentence may end: after a run of stops and what closes behind it, at a line's end, before a bullet.
_PLACES = re.compile(rf"(?<![.!?…])([.!?…]+)([{re.escape(CLOSING)}]*)(?=[{BLANK}])|\n[{BLANK}]*|(?<=[{BLANK}])[{BULLETS}](?=[{BLANK}])")
_BLANKS = re.compile(f"[{BLANK}]*")
_MARKS = re.compile(r"""[()\[\]{}“”‘’"'\n]""")
_LAST_WORD = re.compile(rf"[{_LETTER}](?:[{_LETTER}]|\.(?=[{_LETTER}]))*$")
_ITEM = re.compile(rf"(?:[{DASHES}{BULLETS}]|\(?[0-9]{{1,2}}[.)]|\(?[a-z][.)]|\([A-Za-z]\)|\([ivx]{{1,4}}\)|[ivx]{{1,4}}[.)])(?=[{BLANK}])")
_NUMBERED = re.compile(rf"([0-9]{{1,2}})[.)](?=[{BLANK}])")
_SECOND_ITEM = re.compile(r"(?<=[^\S\n])([2b])[.)](?=[^\S\n])")
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”"}
#: The longest word before a stop that is looked at.
_LOOK_BACK = 24


def _blank(c: str) -> bool:
    return not c or _BLANKS.fullmatch(c) is not None


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def paired(text: str) -> tuple[list[int], list[int]]:
    """Where no sentence ends: (from, to] of the outermost pairs of quotes and brackets, in order. A pair closes on its own line, and what it holds open is dropped."""
    stack: list[tuple[str, int]] = []
    levels: dict[str, list[int]] = {}
    found: list[tuple[int, int]] = []

    def begin(closer: str, at: int) -> None:
        levels.setdefault(closer, []).append(len(stack))
        stack.append((closer, at))

    def finish(closer: str, at: int) -> None:
        level = levels[closer].pop()
        found.append((stack[level][1], at))
        for closed, _ in stack[level + 1 :]:
            if levels[closed] and levels[closed][-1] > level:
                levels[closed].pop()
        del stack[level:]

    for m in _MARKS.finditer(text):
        at, c = m.start(), m[0]
        after, before = text[at + 1 : at + 2], text[at - 1 : at] if at else ""
        wordy = bool(after) and (_cased(after) or after.isdecimal())
        leads = _blank(before) or before in OPENING or before in "-–—/"
        if c == "\n":
            stack.clear()
            levels.clear()
        elif c in _PAIRS:
            begin(_PAIRS[c], at)
        elif c == "‘" or c in "\"'" and not levels.get(c):
            if not _blank(after) if c != "'" else wordy:
                if c == "‘" or leads:
                    begin("’" if c == "‘" else c, at)
        elif levels.get(c) and (c not in "’'" or not wordy and (c == "’" or not _blank(before))):
            finish(c, at)
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], b)
    return [a for a, _ in outer], [b for _, b in outer]


class _Pass:
    """What has been seen of a text: the line, the open sentence, and the lists that go on."""

    def __init__(self, text: str, notes: bool):
        self.text, self.notes = text, notes
        self.line = self.begin = 0
        self.number = self.letter = None  # (value, line, place) of the last item mark
        self.items: set[int] = set()
        self._indent = self._seconds = (-1, None)

    def opens_line(self, at: int) -> bool:
        if self._indent[0] != self.line:
            end = self.line
            while self.text[end : end + 1] in (" ", "\t"):
                end += 1
            self._indent = (self.line, end)
        return self._indent[1] >= at

    def second_follows(self, at: int, which: str) -> bool:
        """Whether the line has a mark 2. or b. behind the place."""
        if self._seconds[0] != self.line:
            end = self.text.find("\n", self.line)
            last = {m[1]: m.start() for m in _SECOND_ITEM.finditer(self.text, self.line, len(self.text) if end < 0 else end)}
            self._seconds = (self.line, last)
        return self._seconds[1].get(which, -1) >= at + 2

    def announced(self, at: int) -> bool:
        """Whether the line says : or ; just before the place."""
        k = at
        while k > self.line and _blank(self.text[k - 1]):
            k -= 1
        return k > self.line and self.text[k - 1] in ":;"

    def item_number(self, value: int, at: int, stop: int) -> bool:
        follows = self.number is not None and self.number[:2] == (value - 1, self.line)
        first = value == 1 and _blank(self.text[at - 1 : at]) and self.announced(at) and self.second_follows(stop, "2")
        if self.opens_line(at) or follows or first:
            self.number = (value, self.line, at)
            self.items.add(at)
            return True
        return False

    def item_letter(self, letter: str, at: int, stop: int) -> bool:
        last = self.letter
        follows = last is not None and last[1] == self.line and last[2] >= self.begin and chr(ord(last[0]) + 1) == letter
        if self.opens_line(at) or follows or (letter == "a" and self.announced(at) and self.second_follows(stop, "b")):
            self.letter = (letter, self.line, at)
            return True
        return False

    def list_goes_on(self, at: int) -> bool:
        """Whether the list of the open sentence has its next number here."""
        last, m = self.number, _NUMBERED.match(self.text, at)
        return bool(m and last and last[1] == self.line and last[2] >= self.begin and int(m[1]) == last[0] + 1)

    def starts(self, at: int, notes: bool) -> tuple[bool, bool]:
        """Whether a sentence may start here, and whether it does so plainly: with a capital, an opening mark or a dash."""
        c = self.text[at]
        upper = _cased(c) and c == c.upper()
        plain = upper or c in OPENING or (c in DASHES + BULLETS and _blank(self.text[at + 1 : at + 2]))
        return plain or "0" <= c <= "9" or c in SIGNS or (notes and _cased(c) and not upper), plain

    def short_form(self, stop: int, at: int, notes: bool) -> bool:
        """Whether the point closes a short form, an initial or an item's mark, before what stands at `at`."""
        text = self.text
        low = max(0, stop - _LOOK_BACK)
        m = _LAST_WORD.search(text[low:stop])
        c = text[at]
        lower = _cased(c) and c == c.lower()
        upper = _cased(c) and not lower
        if m is None:
            k = stop
            while k > low and "0" <= text[k - 1] <= "9":
                k -= 1
            return 0 < stop - k <= 2 and _alone(text, k) and self.item_number(int(text[k:stop]), k, stop)
        word, begins = m[0], low + m.start()
        plain, bare, alone = word.lower(), word.lower().replace(".", ""), _alone(text, begins)
        if (alone and bare in TITLES) or plain in INSIDE or bare in INSIDE:
            return True
        if bare in BEFORE_NUMBER and ("0" <= c <= "9" or c == "#" or (bare in ("no", "nos") and re.match(r"of\b", text[at : at + 3], re.I))):
            return True
        if alone and len(word) == 1:
            if word == plain and _cased(word):
                return not upper or self.item_letter(word, begins, stop)
            if upper and word not in "LR":
                return True
        if alone and upper and re.fullmatch("[A-Z][.][A-Z]", word):
            return True
        return notes and lower and (plain in IN_NOTES or bare in IN_NOTES)

    def ends(self, stop: int, after: int, closed: bool, at: int, notes: bool) -> bool:
        """Whether the stops from `stop` to `after` end a sentence before what stands at `at`; closed: a closing mark lies between."""
        if self.list_goes_on(at):
            return False
        run, (may, plainly) = self.text[stop:after], self.starts(at, notes)
        if run != "." and not run.strip(".…"):  # left-out words
            return plainly and stop > 0 and not _blank(self.text[stop - 1])
        if run == "." and self.short_form(stop, at, notes):
            return False
        return may and (plainly or not closed)

    def line_ends(self, at: int, after: int) -> bool:
        """Whether the break between `at` and `after` ends a sentence."""
        text = self.text
        if self.notes or text.count("\n", at, after) > 1 or _ITEM.match(text, after) or text[at - 1] == ":":
            return True
        if text[at - 1] == ".":
            m = _LAST_WORD.search(text[max(0, at - 1 - _LOOK_BACK) : at - 1])
            if m:
                plain, bare = m[0].lower(), m[0].lower().replace(".", "")
                if plain in INSIDE or bare in INSIDE or (bare in TITLES and _alone(text, at - 1 - len(m[0]))):
                    return False
        c = text[after]
        if not (_cased(c) and c == c.lower()):
            return True
        after_stop = at
        while after_stop and text[after_stop - 1] in CLOSING:
            after_stop -= 1
        stop = after_stop
        while stop and text[stop - 1] in ".!?…":
            stop -= 1
        return stop < after_stop and self.ends(stop, after_stop, after_stop < at, after, True)


def _alone(text: str, at: int) -> bool:
    """Whether a token begins here, opening marks aside."""
    while at and text[at - 1] in OPENING:
        at -= 1
    return not at or _blank(text[at - 1])


def spans(text: str, policy: str = "prose") -> list[tuple[int, int, int, str | None]]:
    """(start, end, start of the words, item mark) of each sentence."""
    if not text:
        return []
    state, cuts, n = _Pass(text, policy == "notes"), [], len(text)
    opened, closed = paired(text)

    def free(at: int) -> bool:
        k = bisect_left(opened, at) - 1
        return k < 0 or at > closed[k]

    def cut(at: int) -> None:
        cuts.append(at)
        state.begin = at

    for m in _PLACES.finditer(text):
        if m[1]:
            after = _BLANKS.match(text, m.end()).end()
            if after < n and text.find("\n", m.end(), after) < 0 and free(m.end()) and state.ends(m.start(), m.end(1), m.end() > m.end(1), after, state.notes):
                cut(m.end())
        elif m[0][0] == "\n":
            at, after = m.start(), m.end()
            while at and _blank(text[at - 1]):
                at -= 1
            if at and after < n and state.line_ends(at, after):
                cut(at)
            state.line = text.rfind("\n", at, after) + 1
        elif free(m.start()) and not state.opens_line(m.start()):
            cut(m.start())
    out, line = [], 0
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        start = _BLANKS.match(text, a).end()
        end = b
        while end > start and _blank(text[end - 1]):
            end -= 1
        if start >= end:
            continue
        line = max(line, text.rfind("\n", a, start) + 1)
        own = text[line:start].strip(" \t") == "" if start - line < 4096 else False
        mark = (_ITEM.match(text, start, end + 1) if own else None) or (_NUMBERED.match(text, start) if start in state.items else None)
        if mark is None and text[start] in BULLETS and _blank(text[start + 1 : start + 2]):
            out.append((start, end, min(end, _BLANKS.match(text, start + 1).end()), text[start]))
        elif mark is None:
            out.append((start, end, start, None))
        else:
            out.append((start, end, min(end, _BLANKS.match(text, mark.end()).end()), mark[0]))
    return out


SPAN = "n int, start int, end int, body int, marker string, gap string, rest string, sentence string"


def split_sentences(rows: DataFrame, *key: str, policy: str = "prose") -> DataFrame:
    """Sentences of rows (key, text): key, n, start, end, body (where the words begin), marker, gap (what lies before it), rest (what follows the last one), sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, cols = [], [[] for _ in range(8)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                found, last = spans(text or "", policy), 0
                for n, (start, end, body, marker) in enumerate(found):
                    of.append(i)
                    for held, value in zip(cols, (n, start, end, body, marker, text[last:start], text[end:] if n + 1 == len(found) else "", text[start:end]), strict=True):
                        held.append(value)
                    last = end
            types = [pa.int32()] * 4 + [pa.string()] * 4
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in key], *map(pa.array, cols, types)], [*key, "n", "start", "end", "body", "marker", "gap", "rest", "sentence"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.select(*key, "text").mapInArrow(run, f"{types}, {SPAN}")


def without(sentences: DataFrame, key: str, drop: Column) -> DataFrame:
    """Texts without the sentences that `drop` picks: key, sentences, removed, text. Where some go between two that stay, the
    stronger of the two gaps beside them stays (more line breaks win)."""
    by_key, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("n")
    breaks = lambda gap: F.length(gap) - F.length(F.replace(gap, F.lit("\n")))
    flagged = sentences.select(key, "n", "gap", "rest", "sentence", F.coalesce(drop, F.lit(False)).alias("gone"))
    # a run: the removed ones before a sentence that stays, and that sentence
    run = flagged.withColumn("run", F.coalesce(F.sum((~F.col("gone")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lead = run.withColumn("lead", F.first("gap").over(Window.partitionBy(key, "run").orderBy("n")))
    gap = F.when((F.col("run") > 0) & (breaks(F.col("gap")) > breaks(F.col("lead"))), F.col("gap")).otherwise(F.col("lead"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("n", F.concat(gap, "sentence").alias("s")))))
    out = lead.groupBy(key).agg(F.count("*").alias("sentences"), F.count_if("gone").alias("removed"), kept.alias("k"), F.max_by("rest", "n").alias("rest"))
    return out.select(key, "sentences", "removed", F.when(F.size("k") > 0, F.concat(F.array_join("k.s", ""), "rest")).otherwise("").alias("text"))


# ---- the same in SQL, for texts in which lists go no further than one mark: marks are set after stops and breaks and taken away again ----

_B = r"\t\x0B\x0C\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_C, _O, _NEXT = r"""["”’')\]}]""", r"""["“‘'(\[{]""", r"0-9#£$€~?"
_FREE = rf"(?:^|[\n{_B}]){_O}*"
_words = lambda ws: "|".join(w.replace(".", "[.]") for w in ws)
_MARKED = [
    (rf"([.!?…]+{_C}*)([{_B}]+)([\p{{Lu}}{_NEXT}\"“‘'(\[{{]|[-*–—·•▪◦‣][{_B}])", r"\1@\2\3"),
    (rf"([.!?…]{_C}+)@([{_B}]+[{_NEXT}])", r"\1\2"),
    (rf"((?:^|[\n{_B}])(?:[.]{{2,}}|…)[.…]*{_C}*)@", r"\1"),
    (rf"((?:[.]{{2,}}|…)[.…]*)@([{_B}]+[{_NEXT}])", r"\1\2"),
    (rf"(?i)({_FREE}(?:{_words(TITLES)})[.]{_C}*)@", r"\1"),
    (rf"(?i)((?:^|[^A-Za-zÀ-ɏ.])(?:{_words(INSIDE)})[.]{_C}*)@", r"\1"),
    (rf"(?i)((?:^|[^A-Za-zÀ-ɏ.])(?:{_words(BEFORE_NUMBER)})[.])@([{_B}]+[0-9#])", r"\1\2"),
    (rf"(?i)((?:^|[^A-Za-zÀ-ɏ.])nos?[.]{_C}*)@([{_B}]+of\b)", r"\1\2"),
    *[(rf"({_FREE}[A-KM-QS-ZÀ-ÖØ-Þ][.]{_C}*)@([{_B}]+\p{{Lu}})", r"\1\2")] * 2,
    (rf"({_FREE}[A-Z][.][A-Z][.]{_C}*)@([{_B}]+\p{{Lu}})", r"\1\2"),
    *[(rf"({_FREE}\p{{Ll}}[.]{_C}*)@([{_B}]+[^\p{{Lu}}{_B}])", r"\1\2")] * 2,
    (rf"((?:^|\n)[ \t]*{_O}*(?:\p{{Ll}}|[0-9]{{1,2}})[.]{_C}*)@", r"\1"),
    *[(r"(\([^()\n@]*)@([^()\n]*\))", r"\1\2")] * 3,
    *[(rf"""((?:^|[\n{_B}])"[^"\n{_B}@][^"\n@]*)@([^"\n]*")""", r"\1\2")] * 3,
    (rf"([^\n{_B}])([{_B}]*\n[\n{_B}]*)", r"\1@\2"),
    (rf"((?:^|[^:.!?…\"”’')\]}}])|[^:.!?…]{_C}+)@([{_B}]*\n[{_B}]*\p{{Ll}})", r"\1\2"),
    (rf"(?i)((?:{_FREE}(?:{_words(TITLES)})|(?:^|[^A-Za-zÀ-ɏ.])(?:{_words(INSIDE)}))[.])@([{_B}]*\n[{_B}]*[^\n{_B}])", r"\1\2"),
    (rf"({_FREE}\p{{Ll}}[.])@([{_B}]*\n[{_B}]*\p{{Ll}})", r"\1\2"),
    (rf"([^\n{_B}@])([{_B}]*\n[{_B}]*(?:\(?[a-z][.)]|[ivx]{{1,4}}[.)])[\n{_B}])", r"\1@\2"),
]


def sentences_sql(source: str, key: str = "doc_id") -> str:
    """CTEs that end in `sentences` (key, n, start, sentence) of the texts of a table."""
    line = f"replace(coalesce(text, ''), '@', chr(2))"
    for form, new in _MARKED:
        form, new = form.replace("'", "''").replace("@", r"\x01"), new.replace("@", "\x01")
        line = f"regexp_replace({line}, '{form}', '{new}', 'g')"
    return f"""marked AS (SELECT {key}, string_split({line}, chr(1)) AS p FROM {source}),
pieces AS (SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM marked),
placed AS (SELECT {key}, k, piece, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k) - length(piece) AS before FROM pieces),
sentences AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS n, CAST(before + length(piece) - length(regexp_replace(piece, '^[\n{_B}]+', '')) AS BIGINT) AS start, replace(regexp_replace(piece, '^[\n{_B}]+|[\n{_B}]+$', '', 'g'), chr(2), '@') AS sentence FROM placed WHERE regexp_matches(piece, '[^\n{_B}]'))"""


@query("WITH " + sentences_sql("documents") + "\nSELECT doc_id, n, start, sentence AS text FROM sentences")
def sentences(spark, sf_dir):
    """Every sentence with its place."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n", "start", F.col("sentence").alias("text"))


#: Terms that a scope leaves out.
TERMS = ("licence", "license", "password", "token")


@query("WITH " + sentences_sql("documents") + f""", held AS (SELECT s.*, regexp_matches(lower(sentence), '\\b({"|".join(TERMS)})\\b') AS gone, start + length(sentence) AS stop FROM sentences s),
gaps AS (SELECT h.doc_id, n, gone, sentence, text, coalesce(lag(stop) OVER w, 0) AS before, start, coalesce(max(CASE WHEN NOT gone THEN n END) OVER (PARTITION BY h.doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM held h JOIN documents d ON d.doc_id = h.doc_id WINDOW w AS (PARTITION BY h.doc_id ORDER BY n)),
own AS (SELECT doc_id, n, last, gone, sentence, substr(text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) AS gap FROM gaps),
kept AS (SELECT a.doc_id, a.n, CASE WHEN a.last >= 0 AND length(a.gap) - length(replace(a.gap, chr(10), '')) > length(f.gap) - length(replace(f.gap, chr(10), '')) THEN a.gap ELSE f.gap END || a.sentence AS part FROM own a JOIN own f ON f.doc_id = a.doc_id AND f.n = a.last + 1 WHERE NOT a.gone)
SELECT doc_id, count(*) FILTER (gone) AS removed, count(*) AS sentences, md5(coalesce((SELECT string_agg(part, '' ORDER BY n) FROM kept k WHERE k.doc_id = h.doc_id) || (SELECT regexp_extract(text, '[\n{_B}]*$') FROM documents d WHERE d.doc_id = h.doc_id), '')) AS kept_md5 FROM held h GROUP BY doc_id""")
def excluded_terms(spark, sf_dir):
    """Each text without the sentences that hold an excluded term, its gaps mended."""
    s = split_sentences(table(spark, sf_dir, "documents"), "doc_id")
    return without(s, "doc_id", F.lower("sentence").rlike(rf"\b({'|'.join(TERMS)})\b")).select("doc_id", "removed", "sentences", F.md5("text").alias("kept_md5"))
