"""Readers of what people type: search texts, replies, payer names, codes, ids with a time, headers, printed conditions; claim checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.cleaning import phone_digits
from wardflow.registry import query
from wardflow.sources.tables import invoice_lines, invoices, sql, table

#: Fixed values that must match as they are: first words of replies, words in payers' and referrers' names, the alphabet of
#: time-sorted ids, and short forms in headers.
CONFIRM = ("YES", "Y", "YEP", "YEAH", "YA", "CONFIRM", "CONFIRMED", "OK", "OKAY", "SURE")
CANCEL = ("C", "NO", "N", "NOPE", "CANCEL", "CANCELLED", "CANCELED")
STOP = ("STOP", "STOPALL", "UNSUBSCRIBE", "END", "QUIT", "OPTOUT", "REVOKE")
PAYER_WORDS = {
    "mlc": r"medico|medical reporting|\bmlc\b|rehabilitation|case management",
    "insurer": r"insur|medical cover|health ?care|\bhealth\b|assurance|\bpmi\b",
    "solicitor": r"solicitor|\blaw\b|\blegal\b|\bllp\b|chambers",
}
REFERRER_WORDS = {"gp": r"\bgp\b|surgery|medical centre|health centre|medical practice", "consultant": r"consultant|orthopaedic|surgeon", "self": r"self"}
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SHORT_FORMS = {"addr": "address", "add": "address", "pcode": "postcode", "pc": "postcode", "tel": "telephone", "mob": "mobile", "fname": "first name", "sname": "surname", "lname": "last name"}
#: Phrases that name nothing, in lower case with single blanks and without a full stop.
NOTHING = ["n/a", "na", "nil", "not applicable", *[f"{word}{seen}" for word in ("none", "nothing") for seen in ("", " reported", " recorded", " noted")], *[f"no {what}" for what in ("restriction", "restrictions", "limitation", "limitations")]]


def by_words(text: Column, rules: dict[str, str]) -> Column:
    """The first class whose words the text holds; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(words), F.lit(name)) for name, words in rules.items()])


def payer_type(name: Column) -> Column:
    return by_words(name, PAYER_WORDS)


def referrer_kind(name: Column) -> Column:
    return F.coalesce(by_words(name, REFERRER_WORDS), payer_type(name), F.when(name.isNotNull(), F.lit("other")))


def reply_intent(text: Column) -> Column:
    """confirm, cancel, stop or unknown, by the first word."""
    words = F.split(F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]+", " ")), " +")
    first, second = words[0], F.get(words, F.lit(1))
    stop = first.isin(*STOP) | (first == "OPT") & F.coalesce(second == "OUT", F.lit(False))
    return F.when(stop, "stop").when(first.isin(*CONFIRM), "confirm").when(first.isin(*CANCEL), "cancel").otherwise("unknown")


def search_kind(text: Column) -> Column:
    """What a search text looks for: dob, number, number_or_phone, phone, email, words or nothing."""
    t, digits = F.trim(text), F.length(F.regexp_replace(text, "[^0-9]", ""))
    numeric = t.rlike(r"^[0-9 +()\-]+$") & (digits > 0)
    return (
        F.when(t.isNull() | (t == ""), "nothing")
        .when(t.rlike(r"^(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})$"), "dob")
        .when(numeric & (digits < 6), "number")
        .when(numeric & (digits <= 7), "number_or_phone")
        .when(numeric, "phone")
        .when(t.contains("@"), "email")
        .otherwise("words")
    )


def diagnosis_code(text: Column) -> Column:
    """'m545' to 'M54.5': a letter, two digits, then perhaps one or two more; else null."""
    t, form = F.upper(F.trim(text)), r"^([A-Z])([0-9]{2})(?:\.?([0-9A-Z]{1,2}))?$"
    part = lambda k: F.regexp_extract(t, form, k)
    return F.when(t.rlike(form), F.concat(part(1), part(2), F.when(part(3) != "", F.concat(F.lit("."), part(3))).otherwise("")))


def outward_code(text: Column) -> Column:
    """The district of a whole or partial postcode; null if it is none."""
    t = F.regexp_replace(F.upper(text), r"\s+", "")
    return F.when(t.rlike(r"^[A-Z]{1,2}[0-9][A-Z0-9]?([0-9][A-Z]{2})?$"), F.coalesce(F.nullif(F.regexp_extract(t, r"^([A-Z]{1,2}[0-9][A-Z0-9]?)[0-9][A-Z]{2}$", 1), F.lit("")), F.when(F.length(t) <= 4, t)))


def time_id_bound(ms: Column) -> Column:
    """The least 26-character id written at an instant (milliseconds since 1970)."""
    digit = lambda k: F.substring(F.lit(CROCKFORD), (F.shiftright(ms, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(9, -1, -1)], F.lit("0" * 16))


def time_of_id(value: Column) -> Column:
    """Milliseconds since 1970 at which an id was written; null for what is no such id."""
    total = F.lit(0).cast("long")
    for k in range(1, 11):
        total = total * 32 + F.position(F.substring(value, k, 1), F.lit(CROCKFORD)) - 1
    return F.when(value.rlike(f"^[{CROCKFORD}]{{26}}$"), total)


def suggest_mapping(fields: dict[str, list[str]], headers: list[str]) -> dict[str, int | None]:
    """Which column of a file holds each field. Every (field, name, column) whose header reads as the name is an offer; offers
    are taken in order of: without a leading 'patient' or 'client' left off, the field, the name, the column. A column
    serves one field."""
    plain = lambda s: " ".join(re.sub(r"[^0-9a-z]+", " ", s.lower()).split())

    def readings(header: str) -> list[str]:
        parts = plain(" ".join(re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", header))).split()
        whole = [SHORT_FORMS.get(w, w) for w in parts]
        return [" ".join(whole), " ".join(whole[1:])] if whole[1:] and whole[0] in ("patient", "patients", "client", "pt") else [" ".join(whole)]

    offers = [(less, f, rank, column) for column, header in enumerate(headers) for less, read in enumerate(readings(header)) for f, names in enumerate(fields.values()) for rank, name in enumerate(names) if plain(name) == read]
    out, taken = dict.fromkeys(fields), set()
    for _, f, _, column in sorted(offers):
        field = list(fields)[f]
        if out[field] is None and column not in taken:
            out[field] = column
            taken.add(column)
    return out


#: What may follow the answer that a printed condition names: nothing, an instruction, or the questions that it is about.
_NO_MORE = r"\s*(?:$|[,.:;?–—)]|(?:please|give|say|state|describe|list|specify|explain|which|why|what|when)\b|(?:to|in|for|on)\b)"


def condition_of(text: Column) -> Column:
    """What a printed condition asks of its questions: struct (wants: yes, no, other or filled; match: any or all); null if
    it can't be read. "If you have not worked" names no answer, and isn't read."""
    low = F.trim(F.lower(text))
    said = F.regexp_extract(low, rf"^if (yes|so|no|not|other|(?:stated|given|specified)){_NO_MORE}", 1)
    wants = F.when(said.isin("yes", "so"), "yes").when(said.isin("no", "not"), "no").when(said == "other", "other").when(said != "", "filled")
    return F.when(wants.isNotNull(), F.struct(wants.alias("wants"), F.when(low.rlike(r"\b(all|both|each)\b"), "all").otherwise("any").alias("match")))


def names_something(text: Column) -> Column:
    """Null for an empty box, false for 'none', 'n/a' and the like."""
    phrase = F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"\.$", ""))
    return F.when(F.trim(text) != "", ~phrase.isin(NOTHING))


def applies(answer: Column, wants: bool, match: str) -> Column:
    """Aggregate of yes/no answers (null: unknown) to true, false or null: any needs one right answer and all need every
    one; an unknown leaves it open unless others settle it."""
    right = answer == F.lit(wants)
    known, n = F.count(answer), F.count(F.lit(1))
    some, every = F.bool_or(right), F.bool_and(right)
    return F.when(some, True).when(known == n, False) if match == "any" else F.when(~every, False).when(known == n, True)


def _pick(options: tuple[str | None, ...], key: str) -> Column:
    """A made-up text by key, in turn."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col(key) % len(options) + 1).cast("int"))


def _pick_sql(options: tuple[str | None, ...], key: str) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {'NULL' if o is None else repr(o)}" for i, o in enumerate(options)) + " END"


_REPLIES = ("yes please", "No, sorry", "STOP", "opt out", "", "Ok!", "c", "maybe", None)
_NAMES = ("Blue Insurance", "Fenn LLP", "Medico Reports", "Hill Surgery", "Self", "Park Health Centre", "A. Consultant", "Lawson", None)
_SEARCHES = ("3/4/1980", "1980-04-03", "12345", "123 4567", "+44 20 7946 0000", "a@b.co", "ann weber", " ", None)
_CODES = ("m545", " S93.4 ", "M54", "54.5", "M54.555", "", None)
_POSTCODES = ("sw1a 1aa", "MK9", "mk9 3xx", "12345", "W1A", "", None)
_words = lambda names, col: "CASE " + " ".join(f"WHEN regexp_matches({col}, '{w}') THEN '{k}'" for k, w in names.items()) + " END"
_list = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""SELECT conv_id, turn, CASE WHEN w[1] IN ({_list(STOP)}) OR (w[1] = 'OPT' AND w[2] = 'OUT') THEN 'stop' WHEN w[1] IN ({_list(CONFIRM)}) THEN 'confirm' WHEN w[1] IN ({_list(CANCEL)}) THEN 'cancel' ELSE 'unknown' END AS intent
FROM (SELECT conv_id, turn, string_split_regex(trim(regexp_replace(upper({_pick_sql(_REPLIES, "(conv_id + turn)")} || ' ' || text), '[^A-Z0-9 ]+', ' ', 'g')), ' +') AS w FROM conversations)""")
def reply_intents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") + F.col("turn"))
    return c.select("conv_id", "turn", reply_intent(F.concat(_pick(_REPLIES, "k"), F.lit(" "), "text")).alias("intent"))


@query(f"""SELECT c_custkey, {_words(PAYER_WORDS, "lower(n)")} AS payer_type, coalesce({_words(REFERRER_WORDS, "lower(n)")}, {_words(PAYER_WORDS, "lower(n)")}, CASE WHEN n IS NOT NULL THEN 'other' END) AS referrer_kind
FROM (SELECT c_custkey, {_pick_sql(_NAMES, "c_custkey")} AS n FROM customer)""")
def name_classes(spark, sf_dir):
    name = _pick(_NAMES, "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", payer_type(name).alias("payer_type"), referrer_kind(name).alias("referrer_kind"))


_only = lambda x, chars: f"len(list_filter(string_split({x}, ''), lambda c: NOT contains('{chars}', c))) = 0"


@query(f"""WITH t AS (SELECT c_custkey, trim({_pick_sql(_SEARCHES, "c_custkey")}) AS s, upper(trim({_pick_sql(_CODES, "c_custkey")})) AS c, upper(replace({_pick_sql(_POSTCODES, "c_custkey")}, ' ', '')) AS p FROM customer),
u AS (SELECT *, len(list_filter(string_split(s, ''), lambda x: contains('0123456789', x))) AS digits, string_split(s, '/') AS d, string_split(s, '-') AS i, replace(c, '.', '') AS b FROM t)
SELECT c_custkey, CASE WHEN coalesce(s, '') = '' THEN 'nothing' WHEN len(d) = 3 AND {_only("s", "0123456789/")} AND length(d[1]) <= 2 AND length(d[2]) <= 2 AND length(d[3]) = 4 OR len(i) = 3 AND {_only("s", "0123456789-")} AND length(i[1]) = 4 AND length(i[2]) = 2 AND length(i[3]) = 2 THEN 'dob'
  WHEN digits > 0 AND {_only("s", "0123456789 +()-")} THEN CASE WHEN digits < 6 THEN 'number' WHEN digits < 8 THEN 'number_or_phone' ELSE 'phone' END WHEN contains(s, '@') THEN 'email' ELSE 'words' END AS kind,
CASE WHEN length(b) BETWEEN 3 AND 5 AND left(b, 1) BETWEEN 'A' AND 'Z' AND {_only("b[2:3]", "0123456789")} AND (length(b) = length(c) OR c[4] = '.' AND length(c) > 4 AND length(c) = length(b) + 1) THEN b[:3] || CASE WHEN length(b) > 3 THEN '.' || b[4:] ELSE '' END END AS code,
CASE WHEN length(p) >= 5 AND {_only("p[-3:-3]", "0123456789")} AND {_only("p[-2:]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AND left(p, 1) BETWEEN 'A' AND 'Z' THEN p[:-4] WHEN length(p) BETWEEN 2 AND 4 AND left(p, 1) BETWEEN 'A' AND 'Z' THEN p END AS district FROM u""")
def typed_values(spark, sf_dir):
    """Kinds of search texts, diagnosis codes and postcode districts."""
    k = "c_custkey"
    return table(spark, sf_dir, "customer").select(k, search_kind(_pick(_SEARCHES, k)).alias("kind"), diagnosis_code(_pick(_CODES, k)).alias("code"), outward_code(_pick(_POSTCODES, k)).alias("district"))


_DIGITS = " || ".join(f"substr('{CROCKFORD}', CAST((ms >> {5 * k}) & 31 AS INTEGER) + 1, 1)" for k in range(9, -1, -1))


@query(f"SELECT o_orderkey, id, ms AS written_ms FROM (SELECT o_orderkey, ms, {_DIGITS} || '0000000000000000' AS id FROM (SELECT o_orderkey, epoch_ms(o_orderdate) + o_orderkey AS ms FROM orders)) WHERE ms >= 883612800000 AND ms < 915148800000")
def time_id_range(spark, sf_dir):
    """Rows whose ids were written in 1998, by bounds of the id alone."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", time_id_bound(ms).alias("id"))
    inside = (F.col("id") >= time_id_bound(F.lit(883612800000))) & (F.col("id") < time_id_bound(F.lit(915148800000)))
    return rows.where(inside).select("o_orderkey", "id", time_of_id(F.col("id")).alias("written_ms"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(a) THEN true WHEN count(a) = count(*) THEN false END AS any_yes, CASE WHEN NOT bool_and(a) THEN false WHEN count(a) = count(*) THEN true END AS all_yes
FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS a FROM lineitem) GROUP BY 1""")
def conditions_met(spark, sf_dir):
    """Whether a condition on yes/no answers applies, is refused, or stays open."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("a"))
    return a.groupBy("l_orderkey").agg(applies(F.col("a"), True, "any").alias("any_yes"), applies(F.col("a"), True, "all").alias("all_yes"))


#: Rules of a bill, in order; each must hold for the bill to go out.
CLAIM_RULES = {
    "not_issued": "total_pence > 0",
    "not_insurer": "payer_type = 'insurer'",
    "membership": "patient_id % 5 <> 0",
    "authorisation_dates": "first_day >= issued_on AND last_day <= issued_on + INTERVAL 60 DAYS",
    "authorisation_sessions": "treatments <= 5",
    "diagnosis_format": "code IS NOT NULL",
    "no_treatments": "treatments > 0",
}
_SESSIONS = "SELECT invoice_id, count(*) AS treatments, min(day) AS first_day, max(day) AS last_day FROM lines GROUP BY 1"
_CLAIMS = f"""claims AS (SELECT i.*, coalesce(treatments, 0) AS treatments, first_day, last_day, CASE i.invoice_id % 7 WHEN 0 THEN 'M54.5' WHEN 1 THEN 'S93.4' WHEN 2 THEN 'M54' END AS code FROM invoices i LEFT JOIN ({_SESSIONS}) s ON s.invoice_id = i.invoice_id),
problems AS ({" UNION ALL ".join(f"SELECT invoice_id, site_id, '{k}' AS code FROM claims WHERE NOT coalesce({'' if k == 'not_insurer' else 'payer_type IS DISTINCT FROM ' + repr('insurer') + ' AND ' + repr(k) + ' <> ' + repr('not_issued') + ' OR '}({r}), false)" for k, r in CLAIM_RULES.items())})"""


def claims(bills: DataFrame, lines: DataFrame, codes: Column) -> DataFrame:
    """Bills with the span and count of their treatments and `problems`, the codes of rules that they break; a bill that
    no insurer pays is judged no further."""
    seen = lines.groupBy("invoice_id").agg(F.count("*").alias("treatments"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    rows = bills.withColumn("code", codes).join(seen, "invoice_id", "left").fillna(0, ["treatments"])
    insured = F.coalesce(F.col("payer_type") == "insurer", F.lit(False))
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)) & (F.lit(code in ("not_issued", "not_insurer")) | insured), F.lit(code)) for code, rule in CLAIM_RULES.items()]
    return rows.withColumn("problems", F.array_compact(F.array(*broken)))


def _claims(spark, sf_dir) -> DataFrame:
    return claims(invoices(spark, sf_dir), invoice_lines(spark, sf_dir), diagnosis_code(_pick(_CODES, "invoice_id")))


@query(sql("invoices lines", "SELECT invoice_id, code FROM problems").replace("\nSELECT invoice_id, code FROM problems", f",\n{_CLAIMS}\nSELECT invoice_id, code FROM problems"))
def claim_problems(spark, sf_dir):
    return _claims(spark, sf_dir).select("invoice_id", F.explode("problems").alias("code"))


@query(sql("invoices lines", "SELECT 1").replace("\nSELECT 1", f",\n{_CLAIMS}\nSELECT site_id, count(*) AS ready FROM claims c WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.invoice_id = c.invoice_id) GROUP BY 1"))
def claim_batches(spark, sf_dir):
    """Bills that are ready to go, by site: a file holds one site."""
    return _claims(spark, sf_dir).where(F.size("problems") == 0).groupBy("site_id").agg(F.count("*").alias("ready"))


def one_line(text: Column, most: int | None = None) -> Column:
    """Runs of white space to one blank, cut to `most` characters; empty is null."""
    out = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.nullif(out if most is None else F.left(out, F.lit(most)), F.lit(""))


def with_lines(text: Column) -> Column:
    """Blanks collapsed, line ends made \\n and kept; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")), F.lit(""))


@query(r"""SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), '')) AS one_line, md5(nullif(trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')), '')) AS with_lines FROM documents""")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(one_line(F.col("text"))).alias("one_line"), F.md5(with_lines(F.col("text"))).alias("with_lines"))


def search_predicate(text: str, number: str, born: str, phone: str, email: str, name: str) -> Column:
    """The predicate on those columns that a search text asks for; every one of its first five words must occur."""
    text = text.strip()[:120]
    uk = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", text)
    digits = re.sub(r"\D", "", text)
    if uk or re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return F.col(born) == F.lit(f"{uk[3]}-{int(uk[2]):02}-{int(uk[1]):02}" if uk else text).cast("date")
    if digits and re.fullmatch(r"[0-9 +()\-]+", text):
        has, phoned = F.col(number) == int(digits), F.col(phone).contains(re.sub(r"^(0044|44)(?=\d{9})", "0", digits))
        return has if len(digits) < 6 else has | phoned if len(digits) <= 7 else phoned
    if "@" in text:
        return F.col(email) == text.lower()
    out = F.lit(True)
    for word in re.sub(r"[^0-9a-z]+", " ", text.lower()).split()[:5]:
        out = out & F.lower(F.col(name)).contains(word)
    return out


@query("""SELECT c_custkey, '07 12' AS search FROM customer WHERE c_custkey = 712 UNION ALL SELECT c_custkey, 'Customer 11' FROM customer WHERE contains(lower(c_name), '11')
UNION ALL SELECT c_custkey, '0000 00012' FROM customer WHERE contains(lpad(CAST(c_custkey AS VARCHAR), 11, '0'), '000000012')""")
def searches(spark, sf_dir):
    """Customers that each of three search texts finds."""
    c = table(spark, sf_dir, "customer").withColumns({"phone": phone_digits(F.lpad(F.col("c_custkey").cast("string"), 11, "0")), "born": F.lit(None).cast("date"), "email": F.lit(None).cast("string")})
    found = [F.when(search_predicate(t, "c_custkey", "born", "phone", "email", "c_name"), F.lit(t)) for t in ("07 12", "Customer 11", "0000 00012")]
    return c.select("c_custkey", F.explode(F.array_compact(F.array(*found))).alias("search"))


def condition_refs(text: Column) -> Column:
    """Numbers of the questions that a printed condition names ('If yes to question 3 or 4'), each once in order; an empty
    array for a condition on the question before it."""
    named = F.regexp_extract(F.lower(text), r"\b(?:questions?|q)\s*(\d{1,2}(?:\s*(?:,|and|or|&)?\s*\d{1,2})*)", 1)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(named, F.lit(r"(\d{1,2})"), F.lit(1)), lambda x: x.cast("int"))))


def judged(answer: Column, wants: Column) -> Column:
    """Whether an answer is what a condition wants; null for a blank one, but a condition on a filled answer refuses it."""
    low = F.lower(F.trim(answer))
    blank = F.coalesce(low == "", F.lit(True))
    return F.when(wants == "filled", ~blank).when(blank, None).when(wants == "yes", low.isin("yes", "y", "true")).when(wants == "no", low.isin("no", "n", "false")).otherwise(low.startswith("other"))


def evaluate_conditions(conditions: DataFrame, answers: DataFrame) -> DataFrame:
    """(form, applies) for conditions (form, question, text) over answers (form, question, answer): true, false, or null while
    it is open. A condition that can't be read stays open; a question without an answer is a blank one."""
    read = conditions.select("form", "question", condition_of(F.col("text")).alias("c"), condition_refs(F.col("text")).alias("refs"))
    asked = read.select("form", "c", F.explode(F.when(F.size("refs") > 0, F.col("refs")).otherwise(F.array((F.col("question") - 1).cast("int")))).alias("question"))
    met = asked.join(answers.select("form", F.col("question").cast("int").alias("question"), "answer"), ["form", "question"], "left")
    found = met.withColumn("right", judged(F.col("answer"), F.col("c.wants")))
    some, every, known = F.bool_or("right"), F.bool_and("right"), F.count("right") == F.count(F.lit(1))
    each = F.first("c.match", ignorenulls=True)
    applies_ = F.when(each == "any", F.when(some, True).when(known, False)).when(each == "all", F.when(~every, False).when(known, True))
    return found.groupBy("form").agg(applies_.alias("applies"))


_CONDITIONS = ("If yes, give details", "If yes to questions 1 or 3", "If no to both questions 2 and 3", "If other, say which", "If stated in question 4", "Details", "If YES to each of questions 1, 2 & 3", "If no to question 9")


@query(f"""WITH f AS (SELECT o_orderkey AS form, lower(([{", ".join(map(repr, _CONDITIONS))}])[CAST(o_orderkey // 3 % {len(_CONDITIONS)} + 1 AS INTEGER)]) AS t FROM orders),
r AS (SELECT form, CASE WHEN regexp_matches(t, '^if other') THEN 'other' WHEN regexp_matches(t, '^if no\\b') THEN 'no' WHEN regexp_matches(t, '^if yes') THEN 'yes' WHEN regexp_matches(t, '^if stated') THEN 'filled' END AS wants, CASE WHEN regexp_matches(t, '\\b(all|both|each)\\b') THEN 'all' ELSE 'any' END AS match,
unnest(CASE WHEN regexp_matches(t, 'questions? [0-9]') THEN list_distinct(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: CAST(x AS INTEGER))) ELSE [4] END) AS q FROM f),
a AS (SELECT r.*, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN CASE WHEN l_linenumber = 4 THEN 'other: gp' ELSE 'no' END WHEN 'N' THEN '' END AS answer FROM r LEFT JOIN lineitem ON l_orderkey = form AND l_linenumber = q),
j AS (SELECT form, match, wants, CASE WHEN wants = 'filled' THEN coalesce(answer, '') <> '' WHEN coalesce(answer, '') = '' THEN NULL WHEN wants = 'other' THEN starts_with(answer, 'other') ELSE answer = wants END AS ok FROM a)
SELECT form, CASE WHEN any_value(wants) IS NULL THEN NULL WHEN any_value(match) = 'any' THEN CASE WHEN bool_or(ok) THEN true WHEN count(ok) = count(*) THEN false END ELSE CASE WHEN NOT bool_and(ok) THEN false WHEN count(ok) = count(*) THEN true END END AS applies FROM j GROUP BY form""")
def conditions_applied(spark, sf_dir):
    """Printed conditions before question 5 of each form, over the answers to its questions."""
    text = F.element_at(F.array(*map(F.lit, _CONDITIONS)), (F.floor(F.col("o_orderkey") / 3) % len(_CONDITIONS) + 1).cast("int"))
    forms = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("form"), F.lit(5).alias("question"), text.alias("text"))
    said = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 4, "Other: GP").otherwise("no")).otherwise(" ")
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("form"), F.col("l_linenumber").alias("question"), said.alias("answer"))
    return evaluate_conditions(forms, answers)
