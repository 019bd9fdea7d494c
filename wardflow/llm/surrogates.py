"""PII surrogates: detected entities get keyed replacements of the same type, script and format.

Mail addresses, phone, card, account and network numbers and secrets go through a keyed permutation of their letters
and digits (each character class among itself; card check digits and address ranges stay valid), so that equal values
always get equal surrogates and two values never get the same one, without any table. Personal names draw from pools
of their gender and script; as pools can't be injective, all names of the corpus are checked for collisions and the
losers draw again until every name has a surrogate of its own. Parts of a name keep their own mapping, so that a later
"Dr Weber" follows "Anna Weber"; and what was found as a name part once in a text is replaced wherever it stands alone
in that text.

Names are found by a title, by a listed given name (particles between it and the last name, or 's behind it), by what says that a name follows ("my name is", "Ansprechpartner:",
"меня зовут", "Contact Last, First"), or by the mail address beside them that repeats them. A name without any of these is not found. Secrets are found
by the word before them in the languages of the names, or by the shape of keys that services give out.

The key is the caller's: who has it can undo the permutations, so it must not stand in code. Equal keys give equal
surrogates in every run.

Defined cases: null texts stay null and have no entity; empty texts stay empty; equal rows are replaced alike; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace

#: Character classes that a surrogate keeps, given names by gender and script, titles by gender.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
GIVEN = {
    ("f", "latin"): "Alice Amelia Angela Anna Anne Beatrice Camille Carla Carmen Caroline Catherine Charlotte Claire Clara Cristina Diana Elena Elisabeth Elizabeth Emily Emma Eva Francesca Hannah Heidi Helena Ingrid Isabel Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucia Margaret Maria Marie Martina Monika Nancy Nicole Olivia Patricia Paula Petra Rachel Rebecca Sandra Sarah Sofia Sophie Susan Teresa Ursula Valeria Victoria".split(),
    ("m", "latin"): "Albert Alejandro Alexander Andrew Antonio Arthur Benjamin Bernard Carlos Charles Christopher Daniel David Dieter Diego Edward Felix Fernando Francois George Gerhard Guillaume Hans Heinrich Henri Henry Hugo Jacques Javier Jean Johannes John Jonathan Jorge Joseph Juan Jürgen Kevin Klaus Lukas Manuel Matthew Michael Miguel Nicolas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Stefan Stephen Thomas Wilhelm William Wolfgang".split(),
    ("f", "cyrillic"): "Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Нина Ольга Полина Светлана Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Михаил Николай Олег Павел Сергей Степан Юрий".split(),
    ("f", "greek"): "Αγγελική Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Βασίλης Γιώργος Δημήτρης Ιωάννης Κώστας Μιχάλης Νίκος Παναγιώτης Χρήστος".split(),
}
TITLES = {"f": "Mrs Ms Miss Mme Mlle Madame Frau Señora Sra Signora".split(), "m": "Mr Mister Monsieur Herr Señor Sr Signor".split(), "u": "Dr Prof Professor Doctor".split()}
#: Syllables of surrogate surnames, by script.
SYLLABLES = {"latin": "ba bel dor fen gar hal kin lan mar nor pel quin ros sel tam ver wick zan".split(), "cyrillic": "ба вел гор дан ков лен мир нор пет рад сол тар".split(), "greek": "βα γερ δω κα λι μαν νικ παπ ρι σταν".split()}
SURNAME_END = {"latin": "ley er ton ström ez ard mann son".split(), "cyrillic": "ов ин ский енко".split(), "greek": "ίδης άκης όπουλος άς".split()}

GIVEN_END = {("f", "latin"): ["a"], ("m", "latin"): ["o", "us"], ("f", "cyrillic"): ["а"], ("m", "cyrillic"): ["ий"], ("f", "greek"): ["α"], ("m", "greek"): ["ος"]}

_KNOWN = {n: g for (g, _), names in GIVEN.items() for n in names}
_TITLED = {t: g for g, ts in TITLES.items() for t in ts}
#: What comes before a name, in the languages of the given names.
CUES = ("my name is", "name:", "contact:", "signed", "sincerely,", "ich heiße", "mein name ist", "ansprechpartner:", "kontakt:", "je m'appelle", "je m’appelle", "nom :", "contact :", "me llamo", "mi nombre es", "contacto:", "меня зовут", "контакт:", "με λένε", "ονομάζομαι", "επικοινωνία:")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆ-Ώ][\w’'-]*[^\W\d_]"
#: Words before a secret, in the languages of the given names. Behind a password's, one word that ends a clause is a secret without a digit too.
_PASSWORD = "password|passwd|pwd|passwort|kennwort|mot de passe|contraseña|пароль|κωδικός"
_SECRET = f"token|secret|api[_-]?key|access[_-]?key|{_PASSWORD}"
#: Beginnings of keys and tokens that services give out.
_ISSUED = ("AKIA", "gh[pousr]_", "xox[abprs]-", "sk-", "eyJ", "(?i:bearer)")
_PARTICLES = "van von de der den del della di da dos la le zu zur ter ten bin ibn al".split()
PATTERNS = {
    "secret": re.compile(rf"(?i)(?<![^\W_])(?:{_SECRET})\b[\"']?\s*(?:[=:]\s*[\"']([^\"'\s]{{6,}})[\"']|=\s*([^\"'\s,;]{{6,}})|:\s*(?=[^\"'\s,;]*\d)([^\"'\s,;]{{5,}}))"),
    "word": re.compile(rf"(?im)(?<![^\W_])(?:{_PASSWORD})\s*:\s*([^\s\"',;]{{5,}}[^\W_])(?=[.,;)]?\s*$|[.,;)]\s)"),
    "issued": re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{16,}|eyJ[\w-]{6,}\.[\w-]{6,}(?:\.[\w-]+)?|(?<=[Bb]earer )[\w.~+/-]{16,})(?![\w-])"),
    "hex": re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z])"),
    "mail": re.compile(r"(?<![\w.+-])[\w.+%-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,}"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w)"),
    "ip6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:.]*[\w:])"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "social": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{2,5}(?:[ .-]\d{2,5}){1,3}(?!\w)|(?<![\w.])\+\d{8,15}(?!\w)|(?<![\w.,-])0\d{9,10}(?![\w-])"),
}
#: A card number that is complete: digits in a row, or in the usual groups.
_COMPLETE = re.compile(r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)|\d{4}([ -])\d{6}\2\d{5}(?!\d)")
_PREFIX = re.compile(r"(?:\+\d{1,3}[ .-]|\)[ .-]?)$")
CUED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, CUES))})\s+(?P<first>{_CAP}) (?P<rest>{_CAP})(?!\w)")
TURNED = re.compile(rf"(?<!\w)(?i:contact|kontakt|contacto|контакт|επικοινωνία|{'|'.join(map(re.escape, CUES))})\s+(?P<rest>(?=\w{{3}}){_CAP}), (?P<first>(?=\w{{3}}){_CAP})(?!\w)")
OWNS = re.compile(rf"(?<!\w)(?P<given>{'|'.join(sorted(_KNOWN, key=len, reverse=True))})(?=[’']s(?!\w))")
BESIDE = re.compile(rf"(?<!\w)(?P<first>{_CAP}) (?P<rest>{_CAP})(?= ?[<(,:]? ?(?P<mail>[\w.+%-]*\w)@)")
NAME = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(_TITLED, key=len, reverse=True))})\.? (?P<titled>{_CAP}(?: {_CAP})?)|(?P<given>{'|'.join(sorted(_KNOWN, key=len, reverse=True))}) (?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}(?P<last>{_CAP}))(?!\w)")
#: What every entity has, for RE2, whose \b and \d know ASCII only: a digit of any script, an at sign, a name or title
#: (as part of a longer word too), a secret's keyword, or a cue.
_SOME = rf"[\p{{Nd}}@]|{'|'.join([*_TITLED, *_KNOWN, *_ISSUED])}|(?i:{_SECRET}|contact|kontakt|контакт|επικοινωνία|{'|'.join(map(re.escape, CUES))})"


def _plain(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def _check_digit(digits: list[int]) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def script_of(name: str) -> str:
    label = unicodedata.name(name[0], "")
    return next((s for s in ("cyrillic", "greek") if s.upper() in label), "latin")


class Keyed:
    """The surrogates of one key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key
        ring = lambda role, script: sorted(GIVEN[role, script], key=lambda n: hmac.new(key, f"{role}\0{n}".encode(), hashlib.sha256).digest())
        self._next = {role: {n: r[i - 1] for script in ("latin", "cyrillic", "greek") for r in [ring(role, script)] for i, n in enumerate(r)} for role in "fm"}

    def _number(self, kind: str, text: str, size: int) -> int:
        return int.from_bytes(hmac.new(self.key, f"{kind}\0{text}".encode(), hashlib.sha256).digest(), "big") % size

    def permuted(self, kind: str, digits: list[int], radix: int) -> list[int]:
        """A keyed permutation of sequences of one length: halves shift each other by keyed amounts, eight times."""
        if len(digits) == 1:
            return [(digits[0] + self._number(kind, f"one{radix}", radix)) % radix]
        cut = len(digits) // 2
        left, right = digits[:cut], digits[cut:]
        for r in range(8):
            value = 0
            for d in left:
                value = value * radix + d
            size = radix ** len(left)
            value = (value + self._number(kind, f"{r}/{radix}/{len(digits)}/{right}", size)) % size
            moved = []
            for _ in left:
                value, d = divmod(value, radix)
                moved.append(d)
            left, right = right, moved[::-1]
        return left + right

    def scrambled(self, kind: str, text: str) -> str:
        """The text with the characters of each class permuted among the class; case and all other characters stay."""
        out, low = list(text), [_plain(c) for c in text]
        for chars in CLASSES:
            at = [i for i, c in enumerate(low) if c in chars]
            if at:
                for i, d in zip(at, self.permuted(kind, [chars.index(low[i]) for i in at], len(chars)), strict=True):
                    up = chars[d].upper()
                    out[i] = up if text[i].isupper() and len(up) == 1 else chars[d]
        return "".join(out)

    def surrogate(self, kind: str, value: str) -> str:
        """The surrogate of a value of any kind but names."""
        if kind == "secret" and PATTERNS["hex"].fullmatch(value):
            kind = "hex"
        if kind == "ip6":
            digits = [int(c, 16) for c in value if c != ":"]
            new = iter(self.permuted(f"{kind}{re.sub('[^:]', 'x', value)}", digits, 16))
            return "".join(c if c == ":" else f"{next(new):X}" if c.isupper() else f"{next(new):x}" for c in value)
        if kind == "ip":
            number = [int(c) for c in f"{int.from_bytes(bytes(map(int, value.split('.'))), 'big'):032b}"]
            return ".".join(map(str, int("".join(map(str, self.permuted(kind, number, 2))), 2).to_bytes(4, "big")))
        if kind == "card":
            digits = [int(c) for c in value if c.isdigit()]
            new = self.permuted(kind, digits[:-1], 10)
            new.append((_check_digit(new) + digits[-1] - _check_digit(digits[:-1])) % 10)
            it = iter(new)
            return "".join(str(next(it)) if c.isdigit() else c for c in value)
        if kind == "mail":
            local, _, domain = value.rpartition("@")
            labels = domain.split(".")
            keep = 2 if labels[-2].lower() == "example" else 1
            return ".".join([self.scrambled(kind, f"{local}@{'.'.join(labels[:-keep])}" if len(labels) > keep else f"{local}@"), *labels[-keep:]]) if len(labels) > keep else f"{self.scrambled(kind, local)}@{domain}"
        if kind == "hex":
            new = self.permuted(kind, [int(c, 16) for c in value], 16)
            return "".join(f"{d:x}".upper() if c.isupper() else f"{d:x}" for c, d in zip(value, new, strict=True))
        if kind == "phone" and value.startswith("+"):
            head = re.match(r"\+\d{1,3}(?=\D)|\+\d", value)[0]
            return head + self.scrambled(kind + head, value[len(head) :])
        return self.scrambled(kind, value)

    def part_surrogate(self, role: str, part: str, attempt: int = 0) -> str:
        """Surrogate of a name part. role: f or m (given names), or s (surnames).

        A given name of the lists is the next one in a keyed ring of its gender and script; any other part is made of
        syllables, with an ending of its script and role, and draws again in attempts after the first.
        """
        if part in self._next.get(role, ()):
            return self._next[role][part]
        script = script_of(part)
        syllables, ends = SYLLABLES[script], SURNAME_END[script] if role == "s" else GIVEN_END[role, script]
        pick = self._number(f"{role}{attempt}", part, len(syllables) ** 3 * len(ends))
        pick, a = divmod(pick, len(syllables))
        pick, b = divmod(pick, len(syllables))
        end, c = divmod(pick, len(syllables))
        middle = syllables[c] if attempt < 4 else "".join(syllables[self._number(f"{role}{attempt}{i}", part, len(syllables))] for i in range(attempt - 2))
        return (syllables[a] + syllables[b] + middle + ends[end]).capitalize()

    def drawn_part(self, kind: str, value: str) -> str | None:
        """The name under which a part is drawn and checked for collisions: role and part; None if it needs no draw."""
        return None if not kind.startswith("name:") or value in self._next.get(kind[5:], ()) else f"{kind[5:]}:{value}"


def _ends(m: re.Match) -> list[int]:
    """Ends of a match at its groups of digits, longest first, where a number may end."""
    return [m.end()] + [m.start() + g.end() for g in reversed(list(re.finditer(r"\d+(?=[ .-][\d(])", m[0])))]


def _n_digits(value: str) -> int:
    return sum(c.isdigit() for c in value)


def _valid(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return _check_digit(digits[:-1]) == digits[-1]


def _card_end(text: str, m: re.Match) -> int | None:
    """End of the card number at a match: at its first complete number unless only more digits give a valid one."""
    ends = [e for e in _ends(m) if 13 <= _n_digits(text[m.start() : e]) <= 19]
    if not ends:
        return None
    whole = _COMPLETE.match(text, m.start(), m.end())
    if whole and whole.end() in ends and (_valid(whole[0]) or not _valid(text[m.start() : ends[0]])):
        return whole.end()
    return ends[0]


def _phone_end(text: str, m: re.Match) -> int | None:
    """End of the phone number at a match: the last group within 15 digits."""
    return next((e for e in _ends(m) if 7 <= _n_digits(text[m.start() : e]) <= 15), None)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Cards and phones in order, each searched from the end of the one before; a rejected match is searched again inside."""
    ends, ahead, pos = {"card": _card_end, "phone": _phone_end}, {"card": (-1, -1), "phone": (-1, -1)}, 0
    while True:
        for kind, end_of in ends.items():
            at = pos
            while ahead[kind] and ahead[kind][0] < pos:
                m = PATTERNS[kind].search(text, at)
                end = m and end_of(text, m)
                ahead[kind] = (m.start(), end) if end else m and ahead[kind]
                at = m.start() + 1 if m else at
        found = [(*span, kind) for kind, span in ahead.items() if span]
        if not found:
            return
        a, pos, kind = min(found, key=lambda f: (f[0], -f[1]))
        yield a, pos, kind, text[a:pos]


def _role(first: str) -> str:
    return _KNOWN.get(first) or ("f" if first[-1] in "aаяα" else "m")


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Parts of names with a title, a listed given name, a cue before them or their own mail address after them."""
    found = []
    for m in NAME.finditer(text):
        if m["given"]:
            found += [(*m.span("given"), f"name:{_KNOWN[m['given']]}", m["given"]), (*m.span("last"), "name:s", m["last"])]
        else:
            parts, at = m["titled"].split(" "), m.start("titled")
            if len(parts) == 2:
                role = _KNOWN.get(parts[0], _TITLED[m["title"]])
                found.append((at, at + len(parts[0]), f"name:{'f' if role == 'f' else 'm'}", parts[0]))
                at += len(parts[0]) + 1
            found.append((at, at + len(parts[-1]), "name:s", parts[-1]))
    found += [(*m.span("given"), f"name:{_KNOWN[m['given']]}", m["given"]) for m in OWNS.finditer(text)]
    for m in [*CUED.finditer(text), *TURNED.finditer(text), *BESIDE.finditer(text)]:
        if "mail" not in m.groupdict() or m["rest"].casefold() in m["mail"].casefold():
            found += [(*m.span("first"), f"name:{_role(m['first'])}", m["first"]), (*m.span("rest"), "name:s", m["rest"])]
    return found


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in order, without overlaps; names come as parts, kind 'name:<role>'."""
    found, taken = [], []
    for kind, pattern in PATTERNS.items():
        if kind in ("card", "phone"):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            kind = "secret" if kind in ("word", "issued") else kind
            found.append((a, b, kind, text[a:b]))
            # a card or phone next to it must not take its digits, unless they follow a phone's own prefix
            if kind not in ("ip", "social") or not _PREFIX.search(text, max(0, a - 8), a):
                taken.append((a, b))
    left = list(text) if taken else text
    for a, b in taken:
        left[a:b] = "_" * (b - a)
    found += _numbers("".join(left))
    names = _names(text)
    found += names
    for value, role in {text[x:y]: k for x, y, k, _ in reversed(names) if y - x > 2}.items():
        at = text.find(value)
        while at >= 0:  # the name part alone
            end = at + len(value)
            if not (at and (text[at - 1].isalnum() or text[at - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_")):
                found.append((at, end, role, value))
            at = text.find(value, end)
    out, end = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _searched(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """Texts in which an entity may be."""
    some = pc.fill_null(pc.match_substring_regex(texts, _SOME), False)
    for i in pc.indices_nonzero(some).to_pylist():
        yield i, texts[i].as_py()


def distinct_parts(parts: DataFrame, space: Workspace, keyed: Keyed) -> DataFrame:
    """(part, attempt) of the name parts that collided and drew again, until all surrogates differ from each other and
    from every part found. Keeps only what isn't a first draw."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [keyed.part_surrogate(p[0], p[2:], a) for p, a in zip(batch.column("part").to_pylist(), batch.column("attempt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["part", "attempt", "drawn"])

    names = space.save(parts.select("part").distinct(), "names")
    state, turn = names.withColumn("attempt", F.lit(0)), 0
    while True:
        drawn = space.save(state.mapInArrow(draw, "part string, attempt int, drawn string"), f"drawn-{turn}")
        first = drawn.groupBy("drawn").agg(F.min(F.struct("attempt", "part"))["part"].alias("owner"), F.count("*").alias("n")).where("n > 1")
        taken = drawn.join(names.select(F.expr("substring(part, 3)").alias("real")), F.col("drawn") == F.col("real")).select(F.col("part").alias("again"))
        losers = drawn.join(first, "drawn").where("part <> owner").select(F.col("part").alias("again")).union(taken).distinct()
        if not losers.head(1):
            return drawn.where("attempt > 0").select("part", "attempt")
        turn += 1
        state = drawn.join(losers, F.col("part") == F.col("again"), "left").select("part", F.when(F.col("again").isNotNull(), F.lit(turn)).otherwise(F.col("attempt")).alias("attempt"))


def replaced(text: str, again: dict[str, int], keyed: Keyed) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and the entities found."""
    found, out, end = entities(text), [], 0
    for a, b, kind, value in found:
        new = keyed.part_surrogate(kind[5:], value, again.get(keyed.drawn_part(kind, value), 0)) if kind.startswith("name:") else keyed.surrogate(kind, value)
        out += [text[end:a], new]
        end = b
    return "".join([*out, text[end:]]), found


def pseudonymise(docs: DataFrame, space: Workspace, key: bytes) -> DataFrame:
    """doc_id, n_entities, kinds, text (with surrogates), one row per document."""
    secret = Keyed(key)

    def name_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for i, text in _searched(batch.column("text")):
                for part in {secret.drawn_part(k, v) for _, _, k, v in entities(text)} - {None}:
                    ids.append(batch.column("row_hash")[i].as_py())
                    parts.append(part)
            yield pa.RecordBatch.from_pydict({"row_hash": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.string())})

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = batch.column("text").to_pylist(), [[] for _ in range(batch.num_rows)]
            for i, text in _searched(batch.column("text")):
                again = {x["part"]: x["attempt"] for x in batch.column("again")[i].as_py() or ()}
                texts[i], found = replaced(text, again, secret)
                kinds[i] = [e[2] for e in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_entities": pa.array([len(k) for k in kinds], pa.int64()), "kinds": pa.array([sorted(set(k)) for k in kinds], pa.list_(pa.string())), "text": pa.array(texts, pa.string())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    parts = space.save(keyed.select("row_hash", "text").mapInArrow(name_parts, "row_hash long, part string"), "parts")
    again = space.save(distinct_parts(parts, space, secret), "again")
    by_row = parts.distinct().join(again, "part").groupBy("row_hash").agg(F.collect_list(F.struct("part", "attempt")).alias("again"))
    return keyed.join(by_row, "row_hash", "left").select("doc_id", "text", "again").mapInArrow(replace, "doc_id long, n_entities long, kinds array<string>, text string")
