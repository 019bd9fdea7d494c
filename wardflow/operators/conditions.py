"""Printed conditions of a form's questions: read once into predicate trees over other questions, and compiled to columns.

A tree is a leaf ("is", question, wanted answer) or ("any" | "all", trees). A question whose words are a condition that can't be
read for sure is open (OPEN): it is asked. What is never guessed: numbered questions, double conditions, words that turn a clause
without being a plain "not", a topic that two questions name. A tree becomes one Column with three-valued logic: true (ask), false (the answers rule it
out), null (not known yet).

What a clause can say, tried in this order: lettered questions ("(a), (b) or (d) is Yes", ranges), the questions above ("yes to either question
above", "any of the above"), yes / no / other with an instruction at most behind it (about the nearest question that can be answered so), and
words of its own, all of which one question near it must hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.classify import names_something
from wardflow.registry import query
from wardflow.sources.tables import table

OPEN = "open"
ANSWERED = ("yes_no", "checkbox", "choice")
#: How many questions back, and on, a clause of its own words may mean; how many back a bare "if yes" may.
FAR, AHEAD, NEAR = 20, 3, 3

# Words that name no topic, stems that only frame one, stems that ask for an opinion, words that turn a clause, instructions.
_EMPTY = set(
    """a an the and or but if only when whether is are was were be been being has have had do does did not no nor never yet still any all either both each this that these those
    there here it its he she him her his hers they them their theirs you your yours we our us i me my of to in on at for from by with as into onto about above below than then so such
    can could will would shall should may might must please give given state describe detail details provide explain expected date who what which why how patient patients client clients
    employee employees claimant claimants person injured yes other""".split()
)
_OPINION = {"expect", "anticipat", "recommend", "advis", "consider", "think", "feel", "believ", "intend", "propos", "suggest", "request", "plan"}
_FRAME = _OPINION | {"keep", "kept", "tick", "select", "chos", "chosen", "giv", "given"}
_PLAIN_NOT = re.compile(r"\b(?:no longer|not|never|no|nor|cannot)\b|n't\b")
_TURNS = re.compile(
    r"\b(?:no longer|not|never|no|nor|cannot|unable|without|off|absent|unfit|unless|except|neither|declin(?:e[sd]?|ing)|refus(?:e[sd]?|ing|al)|stop(?:s|ped|ping)?|ceas(?:e[sd]?|ing)|fail(?:s|ed|ing|ure)?"
    r"|miss(?:es|ed|ing)?|withdr(?:aw|awn|awal|awing|ew)|discontinu(?:e[sd]?|ing)|quit(?:s|ting)?|abandon(?:s|ed|ing)?)\b|n't\b"
)
_INSTRUCTION = re.compile(r"(?:please|give|state|describe|details?|provide|explain|specify|list|say|comments?|which|what|why|when|how|who|where|enter|record|note|then|indicate|outline|add|include)\b")
_NUMBERED = re.compile(r"\b(?:questions?|q\.?|items?|numbers?|no\.|sections?|parts?|boxes?)\s*\d|\b(?:to|for|on|in|at)\s+\d+\b|^\d+\b")
_LETTERS = re.compile(r"(?:(?:yes|no)\s+(?:to|for|on)\s+)?((?:any|all|each|either|both)\s+of\s+(?:questions?\s+)?)?(\(?[a-h]\)?(?:\s*(?:,|\bor\b|\band\b|&|/|[–—-]|\bto\b)\s*\(?[a-h]\)?)+)(?=[\s,.:;?)–—]|$)")
_ABOVE = re.compile(r"\b(either|both|any|all|each)\b(?:\s+of)?(?:\s+the)?(?:\s+(?:two|2))?(?:\s+(?:questions?|answers?|boxes?|items?))?\s+(?:above|before)\b|\b(either|both) of (?:them|these)\b")


@dataclass(frozen=True)
class Question:
    id: str
    label: str
    kind: str = "text"  # yes_no, checkbox, choice, text
    guidance: str = ""
    heading: str = ""
    options: tuple[str, ...] = field(default=())


def _plain(text: str) -> str:
    """Lower case, answer boxes left out, and what is said in two ways said in one."""
    t = re.sub(r"\(?\b(?:yes\s*/\s*no|no\s*/\s*yes|y\s*/\s*n)\b\)?", " ", text.lower().replace("’", "'"))
    t = re.sub(r"\b(?:normal|full)\s+(?:role|dut(?:y|ies))\b", "full duties", t)
    t = re.sub(r"\breturn(?:ed|ing|s)?\b(?=\s+(?:to|at)\b)", "back", t)
    return re.sub(r"\b(?:he or she|she or he|h(?:im|is) or her|her or h(?:im|is)|he/she|h(?:im|is)/her)\b", " person ", t)


def _stem(word: str) -> str:
    cut = re.sub(r"(?:ments?|ions?|ings?|ed|es|s)$", "", word)
    cut = re.sub("y$", "i", re.sub("e$", "", cut if len(cut) >= 3 else word))
    return cut[:-1] if len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeiou" else cut


def _topic(text: str, whole: bool = False) -> list[str]:
    """Stems of what a text is about; whole: its frame and the words that say when as well."""
    t = _plain(text)
    if not whole:
        t = re.sub(r"\bat (?:this|the) (?:stage|time|moment|point)\b|\bat present\b|\bcurrently\b|\bnow\b|\bso far\b", " ", t)
    words = [re.sub("'s$", "", w).replace("'", "") for w in re.split("[^a-z0-9']+", t)]
    stems = [_stem(w) for w in words if len(w) >= 3 and w not in _EMPTY]
    return list(dict.fromkeys(s for s in stems if whole or s not in _FRAME))


def _same(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    return a == b or (len(a) >= 5 and b.startswith(a)) or (len(a) >= 6 and a[:6] == b[:6] and len(b) - len(a) <= 3)


def _within(topic: list[str], words: list[str]) -> bool:
    return all(any(_same(t, w) for w in words) for t in topic)


def _turned(text: str) -> bool:
    return bool(_TURNS.search(_plain(text)))


def _clause(text: str, where: str) -> tuple[str, bool] | None:
    """The words of the first condition, and whether another one widens it. where: label (at its start or after a break), only ("Only if" anywhere), lead (at its start)."""
    t = " ".join(text.split())
    begin = {"label": r"(?:^(?:\(?[a-z0-9]{1,3}[.)]\s*)?|[,;:–—(]\s*|\s-\s)(?:only if|only when|if)\s+", "only": r"(?:^|[.;:–—(]\s*|\s-\s)(?:only if|only when)\s+", "lead": r"^(?:only if|only when|if)\s+"}
    m = re.search(begin[where], t, re.I)
    if m is None or m.end() == len(t):
        return None
    rest = t[m.end() :]
    listed = _LETTERS.match(rest.lower())
    head = listed.end() if listed else 0
    stop = re.search(r"[,:;?–—)]|\s-\s|\.(?:\s|$)", rest[head:])
    end = head + stop.start() if stop else len(rest)
    after = rest[end:]
    return rest[:end].strip(), bool(re.search(begin["label"].replace("^", r"\A"), after, re.I) or re.search(r"\bor\s+(?:only\s+)?(?:if|when)\b", after, re.I))


def _stated(words: str) -> str | None:
    """The answer that a clause states outright: yes, no or other."""
    first = re.match(r"(yes|so|no|not|other)\b", words)
    if first:
        return {"so": "yes", "not": "no"}.get(first[1], first[1])
    said = {a for a in ("yes", "no") if re.search(rf'\b(?:is|are|was|answered|ticked)\s+(?:a\s+)?["“]?{a}\b', words)}
    if re.search(r"\byes\b", words):
        said.add("yes")
    return said.pop() if len(said) == 1 else None


def _nearest(form: list[Question], i: int) -> Question | None:
    return next((form[j] for j in range(i - 1, max(0, i - NEAR) - 1, -1) if form[j].kind in ANSWERED), None)


def _lettered(form: list[Question], i: int, words: str):
    m = _LETTERS.match(words)
    if m is None:
        return None
    names: list[str] = []
    for part in re.split(r"\s*(?:,|\bor\b|\band\b|&|/)\s*", re.sub("[()]", " ", m[2])):
        span = re.fullmatch(r"([a-h])(?:\s*(?:[–—-]|\bto\b)\s*([a-h]))?", part.strip())
        if span is None or (span[2] or span[1]) < span[1]:
            return OPEN
        names += [chr(c) for c in range(ord(span[1]), ord(span[2] or span[1]) + 1)]
    wanted = _stated(words.replace(m[2], " "))
    found = []
    for name in dict.fromkeys(names):
        q = next((form[j] for j in range(i - 1, max(0, i - 26) - 1, -1) if re.match(rf"\s*(?:\({name}\)|{name}[.)]\s)", form[j].label, re.I)), None)
        if q is None or q.kind not in ANSWERED:
            return OPEN
        found.append(q)
    if len(found) < 2 or wanted not in ("yes", "no"):
        return OPEN
    return ("all" if re.match("all|each|both", m[1] or "") else "any", [("is", q.id, wanted) for q in sorted(found, key=form.index)])


def _above(form: list[Question], i: int, words: str):
    m = _ABOVE.search(words)
    if m is None:
        return None
    how, run = m[1] or m[2], []
    for j in range(i - 1, -1, -1):
        if form[j].kind not in ANSWERED or len(run) == 26:
            break
        run.insert(0, form[j])
    run = run[-2:] if how in ("either", "both") else run
    wanted = _stated(words)
    if wanted not in ("yes", "no") or len(run) < (2 if how in ("either", "both") else 1):
        return OPEN
    return ("all" if how in ("both", "all", "each") else "any", [("is", q.id, wanted) for q in run])


def _bare(form: list[Question], i: int, words: str):
    m = re.match(r"(yes|so|no|not|other)\b\s*(.*)$", words)
    if m is None:
        return None
    if m[2] and not _INSTRUCTION.match(m[2]):
        return None if m[1] in ("no", "not") else OPEN
    near = _nearest(form, i)
    if near is None:
        return OPEN
    if m[1] == "other":
        if near.kind == "choice":
            return ("is", near.id, "other")
        return ("is", near.id, "yes") if near.kind == "checkbox" and re.search(r"\bother\b", near.label, re.I) else OPEN
    return ("is", near.id, "yes" if m[1] in ("yes", "so") else "no")


def _row(label: str) -> str | None:
    m = re.match(r"(.+?)\s+[–—-]\s+\S", label.strip())
    return m and m[1].strip().lower()


def _says_more(words: str, q: Question, topic: list[str]) -> bool:
    """Whether a yes/no question asks more than the clause: for an opinion where that states a fact, or for more than its one word."""
    clause, asked = _topic(_PLAIN_NOT.sub(" ", words), True), _topic(q.label, True)
    if set(asked) & _OPINION and not set(clause) & _OPINION:
        return True
    return len(topic) == 1 and not _within([w for w in asked if w not in _FRAME], clause)


def _own_words(form: list[Question], i: int, words: str, least: int):
    plain = _plain(words)
    nots, turns = len(_PLAIN_NOT.findall(plain)), len(_TURNS.findall(plain))
    wanted = "no" if nots == turns == 1 else "yes" if turns == 0 else None
    topic = _topic(_PLAIN_NOT.sub(" ", words.lower()))
    if wanted is None or len(topic) < max(1, least):
        return OPEN
    found: list[tuple[Question, str | None]] = []
    for q in (form[j] for j in range(max(0, i - FAR), min(len(form), i + AHEAD + 1)) if j != i):
        if q.kind not in ANSWERED or _turned(q.label):
            continue
        own = _topic(q.label)
        if q.kind == "choice":
            named = [o for o in q.options if not _turned(o) and _within(topic, own + _topic(o)) and any(_same(t, w) for t in topic for w in _topic(o))]
            if len(named) > 1:
                return OPEN
            found += [(q, o) for o in named]
        elif _within(topic, own) and not (q.kind == "yes_no" and (re.search(r"\bor\b", _plain(q.label)) or _says_more(words, q, topic))):
            found.append((q, None))
    if len(found) == 1 and (len(topic) > 1 or found[0][0] == _nearest(form, i)):
        q, option = found[0]
        if option is not None and len(option) > 200:
            return OPEN
        return ("is", q.id, wanted) if option is None else ("is" if wanted == "yes" else "is not", q.id, f"={option}")
    if wanted == "yes" and not found and _row(form[i].label):
        boxes = [q for q in form[max(0, i - NEAR) : i] if q.kind == "text" and _row(q.label) == _row(form[i].label) and _within(topic, _topic(q.label))]
        if len(boxes) == 1:
            return ("is", boxes[0].id, "filled")
    return OPEN


def _read(form: list[Question], i: int, clause: tuple[str, bool], bare: bool = True, least: int = 1):
    words = clause[0].lower()
    if not words or clause[1] or _NUMBERED.search(words):
        return OPEN
    for form_of in (_lettered, _above):
        tree = form_of(form, i, words)
        if tree is not None:
            return tree
    tree = _bare(form, i, words)
    if tree is not None:
        return tree if bare else OPEN
    return _own_words(form, i, clause[0], least)


def condition(form: list[Question], i: int):
    """The tree of the i-th question's condition, OPEN for one that can't be read, None for a question without one."""
    q = form[i]
    tree = _condition(form, i)
    # a choice prints an option of its own for what doesn't apply, but for boxes of its row that are filled
    return tree if q.kind != "choice" or (isinstance(tree, tuple) and tree[-1] == "filled") else None


def _condition(form: list[Question], i: int):
    q = form[i]
    for text, where in ((q.label, "label"), (q.guidance, "only")):
        clause = _clause(text, where)
        if clause:
            return _read(form, i, clause)
    heading = q.heading if not any(o.label.strip().lower() == q.heading.strip().lower() for o in form[:i]) else ""
    for text in (q.guidance, heading):
        clause = _clause(text, "lead")
        tree = _read(form, i, clause, bare=False, least=2) if clause else OPEN
        if tree != OPEN:
            return tree
    if re.search(r"(?:^|[\s–—-])if other\b", q.label, re.I):
        near = _nearest(form, i)
        return ("is", near.id, "other") if near and near.kind == "choice" else OPEN
    reasons = re.match(r"(?:the\s+)?(?:rationale|reasons?|justification|grounds)\s+(?:for|why)\s+(.+)$", q.label.strip(), re.I)
    if reasons and not _turned(reasons[1]):
        near, topic = _nearest(form, i), _topic(reasons[1])
        if near and near.kind != "choice" and not _turned(near.label) and topic and _within(topic, _topic(near.label)):
            return ("is", near.id, "yes")
    details = re.match(r"(.+?)\s+[–—-]\s+(?:details?|comments?|please (?:give details|specify)|specify|describe)\s*:?$", q.label.strip(), re.I)
    if details and i:
        last = form[i - 1]
        if _row(last.label) == details[1].strip().lower():
            tree = _condition(form, i - 1)
            if isinstance(tree, tuple):
                return tree
        topic = _topic(details[1])
        if last.kind == "yes_no" and not _turned(last.label) and not _turned(details[1]) and topic and _within(topic, _topic(last.label)):
            return ("is", last.id, "yes")
    return None


def conditions(form: list[Question]) -> dict[str, object]:
    """The conditions of a form's questions by their ids."""
    return {q.id: tree for i, q in enumerate(form) if (tree := condition(form, i)) is not None}


def applies(tree, answers: dict[str, Column]) -> Column:
    """One column for a tree: true, false, or null while it is open or an answer is missing. answers: the answer of each question as text."""
    if tree == OPEN:
        return F.lit(None).cast("boolean")
    if tree[0] in ("any", "all"):
        parts = [applies(t, answers) for t in tree[1]]
        return reduce(lambda a, b: (a | b) if tree[0] == "any" else (a & b), parts)
    how, question, wanted = tree
    if question not in answers:
        return F.lit(None).cast("boolean")
    said = F.lower(F.trim(F.regexp_replace(answers[question], r"\s+", " ")))
    if wanted == "filled":
        return names_something(answers[question])
    if wanted.startswith("="):
        hit = said == " ".join(wanted[1:].lower().split())
    elif wanted == "other":
        hit = said.rlike(r"\bother\b")
    else:
        hit = F.when(said.isin("y", "yes", "true"), wanted == "yes").when(said.isin("n", "no", "false"), wanted == "no")
    return F.when(said != "", hit if how == "is" else ~hit)


def with_conditions(rows: DataFrame, form: list[Question]) -> DataFrame:
    """Adds applies_<id> for each question with a condition to rows that hold the answer to each question in a column of its id."""
    here = {q.id: F.col(f"`{q.id}`") for q in form if q.id in rows.columns}
    return rows.withColumns({f"applies_{name}": applies(tree, here) for name, tree in conditions(form).items()})


#: The form that is answered by the lines of an order.
FORM = [
    Question("q1", "(a) Is more treatment advised?", "yes_no"),
    Question("q2", "(b) Has the client gone back to work?", "yes_no"),
    Question("q3", "(c) Kind of work", "choice", options=("Full duties", "Light duties", "Other")),
    Question("n8", "Kind – if other, which"),
    Question("q4", "Home tasks – task still limited"),
    Question("n5", "Home tasks – how limited", guidance="Only when a task is still limited."),
    Question("n1", "If (a) or (b) is Yes, give details"),
    Question("n2", "If yes to both of (a) and (b), say when"),
    Question("n3", "If not gone back to work, the expected date"),
    Question("n4", "If not yet on full duties, list the limits"),
    Question("n6", "If you have not worked, give reasons"),
    Question("n7", "If yes to question 1, describe it"),
]
_yes = lambda q, word: f"CASE {q} WHEN 'Yes' THEN {word == 'yes'} WHEN 'no' THEN {word == 'no'} END"


@query(f"""WITH a AS (SELECT l_orderkey AS form, max(CASE WHEN l_linenumber = 1 THEN CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'no' END END) AS q1, max(CASE WHEN l_linenumber = 2 THEN CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'no' END END) AS q2,
max(CASE WHEN l_linenumber = 3 THEN CASE WHEN l_partkey % 5 < 2 THEN 'Full  Duties' WHEN l_partkey % 5 < 4 THEN 'light duties' ELSE 'Other' END END) AS q3, max(CASE WHEN l_linenumber = 4 THEN CASE WHEN l_partkey % 3 = 0 THEN 'None reported.' ELSE 'task ' || l_partkey END END) AS q4 FROM lineitem GROUP BY 1)
SELECT form, ({_yes('q1', 'yes')}) OR ({_yes('q2', 'yes')}) AS n1, ({_yes('q1', 'yes')}) AND ({_yes('q2', 'yes')}) AS n2, {_yes('q2', 'no')} AS n3, q3 <> 'Full  Duties' AS n4, q4 <> 'None reported.' AS n5, CAST(NULL AS BOOLEAN) AS n6, CAST(NULL AS BOOLEAN) AS n7, q3 = 'Other' AS n8 FROM a""")
def conditions_compiled(spark, sf_dir):
    """Which conditional questions apply to each order, whose lines answer the questions before them by flag and part."""
    line, flag, part = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_partkey")
    said = F.when(line <= 2, F.when(flag == "A", "Yes").when(flag == "R", "no")).when(line == 3, F.when(part % 5 < 2, "Full  Duties").when(part % 5 < 4, "light duties").otherwise("Other")).when(line == 4, F.when(part % 3 == 0, "None reported.").otherwise(F.concat(F.lit("task "), part.cast("string"))))
    answers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("form")).agg(*[F.max(F.when(line == k, said)).alias(f"q{k}") for k in range(1, 5)])
    out = with_conditions(answers, FORM)
    return out.select("form", *[F.col(f"applies_n{k}").alias(f"n{k}") for k in range(1, 9)])
