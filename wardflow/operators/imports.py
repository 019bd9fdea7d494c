"""Import of four kinds of files (patients, cases, appointments, invoices): cells as text to records with issues.

A kind is a table of fields: how each cell is read, whether it must be there and how long it may be. Reading is one
projection: a column for each value and one array of issues; rules that compare values follow as expressions over the
values. What can't be read is left blank with a warning, or with an error where the record needs it; nothing is guessed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators import cleaning as C
from wardflow.registry import query
from wardflow.sources.tables import table

#: What status and payer words stand for.
WORDS = {
    "patient_status": {"active": "active current yes y live".split(), "archived": ["archived", "inactive", "no", "n", "left", "not active"], "deceased": "deceased died dead".split()},
    "case_status": {"open": ["open", "active", "current", "ongoing", "in progress"], "discharged": "discharged complete completed finished".split(), "closed": "closed cancelled canceled archived".split()},
    "payer": {
        "self_pay": ["self pay", "selfpay", "self", "private", "patient", "self funded"],
        "insurer": ["insurance", "insurer", "insured", "pmi", "private medical insurance", "health insurance"],
        "mlc": ["medico legal", "medicolegal", "mlc", "medical reporting", "medical reporting agency", "agency", "legal"],
        "solicitor": ["solicitor", "solicitors", "law firm"],
        "employer": ["employer", "company", "corporate", "occupational health"],
        "other": ["other", "nhs", "charity"],
    },
    "appointment_status": {
        "attended": "attended arrived completed complete seen att yes".split(),
        "did_not_attend": ["dna", "did not attend", "didnt attend", "did not arrive", "no show", "noshow", "failed", "failed to attend"],
        "late_cancellation": ["lcn", "late cancellation", "late cancel", "late cancelled", "short notice cancellation"],
        "cancelled": ["cancelled", "canceled", "cnc", "cancellation", "cancelled with notice"],
        "booked": "booked confirmed pending scheduled future unconfirmed".split(),
    },
    "invoice_status": {
        "paid": ["paid", "settled", "paid in full"],
        "part_paid": ["part paid", "partly paid", "partially paid", "part payment"],
        "unpaid": "unpaid outstanding open due overdue issued".split(),
        "written_off": ["written off", "write off", "bad debt"],
        "void": "void voided cancelled canceled credited".split(),
    },
}


@dataclass(frozen=True)
class Cell:
    """How a field's cell is read. kind: text, date, time, money, int, yesno, sex, email, phone, postcode or a table of WORDS."""

    kind: str = "text"
    required: bool = False
    most: int = 200
    least: int = 0

    #: The code of a cell that can't be read.
    CODES = {"date": "INVALID_DATE", "time": "INVALID_TIME", "money": "INVALID_MONEY", "int": "INVALID_NUMBER", "email": "INVALID_EMAIL", "phone": "INVALID_PHONE", "postcode": "INVALID_POSTCODE"}

    def value(self, raw: Column) -> Column:
        one_line = F.trim(F.regexp_replace(raw, r"\s+", " "))
        readers = {
            "text": lambda: F.trim(F.left(one_line, F.lit(self.most))),
            "date": lambda: C.read_date(raw),
            "time": lambda: C.read_time(raw),
            "money": lambda: C.money_pence(raw),
            "int": lambda: C.read_int(raw, self.least, self.most),
            "yesno": lambda: C.yes_no(raw),
            "sex": lambda: C.read_sex(raw),
            "email": lambda: C.email(raw),
            "phone": lambda: F.when(C.plausible_phone(raw), one_line),
            "postcode": lambda: C.postcode(raw),
        }
        if self.kind in WORDS:
            key = C.search_key(raw)
            return F.coalesce(*[F.when(key.isin(words), F.lit(name)) for name, words in WORDS[self.kind].items()])
        return F.when(raw != "", readers[self.kind]())

    def problem(self, raw: Column, value: Column, field: str) -> Column:
        """The issue 'CODE:severity:field' of a cell, or null."""
        blank = raw == ""
        out = F.when(blank, F.lit(f"REQUIRED:error:{field}")) if self.required else F.when(blank, F.lit(None))
        if self.kind == "text":
            return out.when(F.length(F.trim(F.regexp_replace(raw, r"\s+", " "))) > self.most, f"SHORTENED:warning:{field}")
        severity = "error" if self.kind == "time" or self.required else "warning"
        return out.when(value.isNull(), f"{self.CODES.get(self.kind, 'INVALID_VALUE')}:{severity}:{field}")


TEXT, NEEDED = Cell(), Cell(required=True)
KINDS: dict[str, dict[str, Cell]] = {
    "patients": {
        "ref": NEEDED, "title": Cell(most=20), "firstName": Cell(most=80), "lastName": Cell(most=80), "fullName": Cell(most=160), "dateOfBirth": Cell("date"), "sex": Cell("sex"), "email": Cell("email"), "phoneMobile": Cell("phone"),
        "town": Cell(most=120), "postcode": Cell("postcode"), "reminderSms": Cell("yesno"), "marketingEmail": Cell("yesno"), "marketingSms": Cell("yesno"), "status": Cell("patient_status"),
    },
    "cases": {
        "ref": NEEDED, "patientRef": NEEDED, "title": TEXT, "openedOn": Cell("date", True), "closedOn": Cell("date"), "status": Cell("case_status"), "payerType": Cell("payer"), "authorisationCode": Cell(most=40),
        "sessionsAuthorised": Cell("int", most=999), "sessionsUsed": Cell("int", most=999), "authorisationExpiresOn": Cell("date"), "excess": Cell("money"),
    },
    "appointments": {
        "ref": NEEDED, "patientRef": NEEDED, "date": Cell("date", True), "startTime": Cell("time"), "endTime": Cell("time"), "durationMinutes": Cell("int", most=480, least=5), "practitionerName": NEEDED, "status": Cell("appointment_status"),
        "charge": Cell("money"),
    },
    "invoices": {
        "ref": NEEDED, "patientRef": NEEDED, "issuedOn": Cell("date", True), "dueOn": Cell("date"), "total": Cell("money", True), "paid": Cell("money"), "balance": Cell("money"), "payerType": Cell("payer"), "status": Cell("invoice_status"),
    },
}

#: By kind: further values over the read ones (v_field, raw cells as r_field), in order; each may use those before it.
VALUES = {
    "patients": [
        ("dateOfBirth_read", "v_dateOfBirth"),
        ("v_dateOfBirth", "CASE WHEN v_dateOfBirth BETWEEN DATE '1900-01-01' AND today THEN v_dateOfBirth END"),
        ("v_status", "coalesce(v_status, 'active')"),
        ("v_marketingEmail", "coalesce(v_marketingEmail, false)"),
        ("v_marketingSms", "coalesce(v_marketingSms, false)"),
        ("usable", "v_ref IS NOT NULL AND v_firstName IS NOT NULL AND v_lastName IS NOT NULL"),
    ],
    "cases": [
        ("v_title", "coalesce(v_title, 'Case from the earlier system')"),
        ("backwards", "coalesce(v_closedOn < v_openedOn, false)"),
        ("v_closedOn", "CASE WHEN NOT backwards THEN v_closedOn END"),
        ("v_status", "coalesce(v_status, CASE WHEN v_closedOn IS NULL THEN 'open' ELSE 'discharged' END)"),
        ("v_closedOn", "CASE WHEN v_status <> 'open' THEN v_closedOn END"),
        ("over", "v_authorisationCode IS NOT NULL AND coalesce(v_sessionsUsed > v_sessionsAuthorised, false)"),
        ("adrift", "v_authorisationCode IS NULL AND (v_sessionsAuthorised IS NOT NULL OR v_sessionsUsed IS NOT NULL OR v_authorisationExpiresOn IS NOT NULL)"),
        ("v_sessionsUsed", "CASE WHEN v_authorisationCode IS NOT NULL THEN least(coalesce(v_sessionsUsed, 0), coalesce(v_sessionsAuthorised, 999)) END"),
        ("v_excess", "CASE WHEN v_excess >= 0 THEN v_excess END"),
        ("usable", "v_ref IS NOT NULL AND v_patientRef IS NOT NULL AND v_openedOn IS NOT NULL"),
    ],
    "appointments": [
        ("late_end", "v_durationMinutes IS NULL AND coalesce(v_endTime <= v_startTime, false)"),
        ("v_durationMinutes", "coalesce(v_durationMinutes, CASE WHEN v_endTime > v_startTime THEN v_endTime - v_startTime END)"),
        ("v_charge", "CASE WHEN v_charge >= 0 THEN v_charge END"),
        ("usable", "v_ref IS NOT NULL AND v_patientRef IS NOT NULL AND v_date IS NOT NULL AND v_startTime IS NOT NULL AND v_practitionerName IS NOT NULL AND NOT late_end AND NOT (r_endTime <> '' AND v_endTime IS NULL)"),
    ],
    "invoices": [
        ("unequal", "coalesce(v_total - v_paid <> v_balance, false)"),
        ("v_paid", "coalesce(v_paid, v_total - v_balance, 0)"),
        ("v_balance", "coalesce(v_balance, v_total - v_paid, 0)"),
        ("v_status", "coalesce(v_status, CASE WHEN v_balance <= 0 THEN 'paid' WHEN v_paid > 0 THEN 'part_paid' ELSE 'unpaid' END)"),
        ("v_balance", "CASE WHEN v_status IN ('void', 'written_off') THEN 0 ELSE v_balance END"),
        ("usable", "v_ref IS NOT NULL AND v_patientRef IS NOT NULL AND v_issuedOn IS NOT NULL AND v_total IS NOT NULL"),
    ],
}
#: By kind: issues that compare values: (CODE:severity:field, condition).
RULES = {
    "patients": [
        ("NAME_SPLIT:warning:fullName", "name_split"),
        ("REQUIRED:error:firstName", "v_firstName IS NULL"),
        ("REQUIRED:error:lastName", "v_lastName IS NULL"),
        ("DATE_OF_BIRTH_RANGE:warning:dateOfBirth", "dateOfBirth_read IS NOT NULL AND v_dateOfBirth IS NULL"),
        ("MARKETING_IMPORTED:warning:marketingEmail", "v_marketingEmail"),
        ("MARKETING_IMPORTED:warning:marketingSms", "v_marketingSms AND NOT v_marketingEmail"),
    ],
    "cases": [("ENDS_BEFORE_START:warning:closedOn", "backwards"), ("AUTHORISATION_INCOMPLETE:warning:authorisationCode", "adrift"), ("USED_OVER_AUTHORISED:warning:sessionsUsed", "over")],
    "appointments": [("REQUIRED:error:startTime", "r_startTime = '' AND v_startTime IS NULL"), ("ENDS_BEFORE_START:error:endTime", "late_end")],
    "invoices": [("BALANCE_MISMATCH:warning:balance", "unequal")],
}


def read_rows(rows: DataFrame, kind: str, today: Column) -> DataFrame:
    """Rows of cells (a text column for each field of the kind; a missing one counts as blank) with v_<field>, `usable`
    (the record can be imported) and `issues` (CODE:severity:field, in order). Other columns stay."""
    cells = KINDS[kind]
    out = rows.withColumns({f"r_{f}": F.trim(F.coalesce(F.col(f), F.lit(""))) if f in rows.columns else F.lit("") for f in cells}).withColumn("today", today)
    out = out.withColumns({f"v_{f}": c.value(F.col(f"r_{f}")) for f, c in cells.items()})
    out = out.withColumn("found", F.array(*[c.problem(F.col(f"r_{f}"), F.col(f"v_{f}"), f) for f, c in cells.items()]))
    if kind == "patients":
        out = _names(out)
    elif kind == "appointments":  # the time may stand after the date
        out = out.withColumn("v_startTime", F.when(F.col("r_startTime") == "", C.read_time(F.col("r_date"))).otherwise(F.col("v_startTime")))
    for name, expression in VALUES[kind]:
        out = out.withColumn(name, F.expr(expression))
    compared = F.array(*[F.when(F.expr(test), F.lit(issue)) for issue, test in RULES[kind]])
    return out.withColumn("issues", F.array_sort(F.array_compact(F.concat("found", compared)))).drop("found", "today")


def _names(rows: DataFrame) -> DataFrame:
    """First, last name and title from a whole name where one is missing, or a title before the first name."""
    short = F.col("v_firstName").isNull() | F.col("v_lastName").isNull()
    whole, before = C.split_name(F.col("r_fullName")), C.split_title(F.col("v_firstName"))
    rows = rows.withColumns({"_whole": F.when(short & (F.col("r_fullName") != ""), whole), "_before": F.when(F.col("v_title").isNull() & ~(short & (F.col("r_fullName") != "")), before)})
    split = F.col("_whole").isNotNull()
    return rows.withColumns({
        "name_split": split,
        "v_title": F.coalesce("v_title", F.col("_whole.title"), F.col("_before.title")),
        "v_firstName": F.when(F.col("_before.title").isNotNull(), F.col("_before.rest")).otherwise(F.coalesce("v_firstName", F.left(F.col("_whole.first"), F.lit(80)))),
        "v_lastName": F.coalesce("v_lastName", F.left(F.col("_whole.last"), F.lit(80))),
    }).drop("_whole", "_before")


# ---- made-up files: each cell is one of a few texts, picked by the row's number; and the SQL that reads them ----

TODAY = "2026-06-01"
_LONG = "Long name " * 12
_CELLS = {
    "patients": {
        "ref": ("P1", " P 2 ", "", "P4", "P5"), "title": ("", "Mrs", "", ""), "firstName": ("Megan", "", "Dr Ann", _LONG, "Jo", ""), "lastName": ("Hart", "Quinn", "", "O'Neill", "Weber"), "fullName": ("", "Hart, Mrs Megan", "Prof. Bo  Li Chen", "Cher", "", "Li, "),
        "dateOfBirth": ("03/04/1980", "1980-13-01", "3 Apr 80", "2030-01-01", "", "31/12/1899", "3 marvellous 2021"), "sex": ("F", "male", "Non-binary", "yes", "", "not stated"), "email": ("A@B.co", "a b@c.d", "", "x@y", "j.w@mail.example.com "),
        "phoneMobile": ("07700 900123", "+44 (0)20 7946 0958", "12345", "+1 415 555 2671", "", "0044 20 7946 0958", "call me"), "town": ("Milton  Keynes", "", "Bath"), "postcode": ("mk39zz", "SW1A 1AA", "1234", "", "W1A0AX"),
        "reminderSms": ("Y", "no", "", "maybe", "opted out"), "marketingEmail": ("", "yes", "no", "?"), "marketingSms": ("x", "", "declined"), "status": ("Active", "", "Not active", "died", "gone away"),
    },
    "cases": {
        "ref": ("C1", "", "C3", "C4"), "patientRef": ("P1", "P2", "", "P4", "P5"), "title": ("", "Knee  pain", "x" * 230), "openedOn": ("01/02/2025", "2025-02-01T09:30:00", "", "1 Feb 25", "01.02.2025 10:00", "02/30/2025"), "closedOn": ("", "2025-03-01", "3 Jan 2025", "x", "31-Mar-2025", "30/02/2025"),
        "status": ("", "In progress", "Finished", "?", "Cancelled"), "payerType": ("Insurance", "self-pay", "", "Law firm", "N.H.S.", "Medico-legal"), "authorisationCode": ("A1", "", "A3"), "sessionsAuthorised": ("6", "", "1000", "4", "-1"), "sessionsUsed": ("2", "9", "", "x"),
        "authorisationExpiresOn": ("", "2025-12-31", "soon"), "excess": ("£100", "", "(20.00)", "1,00", "GBP 1,250.50"),
    },
    "appointments": {
        "ref": ("A1", "A2", "", "A4"), "patientRef": ("P1", "", "P3", "P4", "P5"), "date": ("03/04/2026 09:30", "2026-04-03", "", "3 April 26", "03-Apr-2026", "31/04/2026", "2026-04-03T14:05:00"), "startTime": ("", "9:30", "0930", "9", "2:15 PM", "12am", "25:00"),
        "endTime": ("", "10.15", "9.00am", "late", "2.45 p.m."), "durationMinutes": ("", "30", "4", "45.5"), "practitionerName": ("Dr Okafor", "", "Ms Li"), "status": ("", "DNA", "arrived", "No-show", "late cancelled", "zzz"), "charge": ("55", "£1,234.50", "", "12.345", "-5"),
    },
    "invoices": {
        "ref": ("I1", "I2", "I3", ""), "patientRef": ("P1", "P2", "", "P4", "P5"), "issuedOn": ("01/02/2025", "2025/02/01", "2025-2-1", "", "1-February-2025"), "dueOn": ("", "15/02/25", "15 Sept 2025", "99/99/2025"), "total": ("100", "£55.00", "", "abc", "1,000.10", "2000000"), "paid": ("", "40", "55.00", "x"),
        "balance": ("", "60", "0", "-5.00", "15"), "payerType": ("", "Employer", "Agency", "whoever"), "status": ("", "Paid in full", "bad debt", "Void", "Part payment", "hmm"),
    },
}
_TABLE = {"patients": ("customer", "c_custkey"), "cases": ("orders", "o_orderkey"), "appointments": ("events", "event_id"), "invoices": ("part", "p_partkey")}


def _made_up(spark, sf_dir, kind: str) -> DataFrame:
    name, key = _TABLE[kind]
    pick = lambda f, texts: F.element_at(F.array(*map(F.lit, texts)), (F.floor(F.col(key) / (1 + i[f])) % len(texts) + 1).cast("int"))
    i = {f: n for n, f in enumerate(_CELLS[kind])}
    return table(spark, sf_dir, name).select(F.col(key).alias("row_id"), *[pick(f, t).alias(f) for f, t in _CELLS[kind].items()])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


def _sql_reader(cell: Cell, r: str) -> str:
    """The SQL that reads a cell r, on its own terms: lists of forms, try_strptime and casts."""
    line = rf"trim(regexp_replace({r}, '\s+', ' ', 'g'))"
    low = f"lower({line})"
    if cell.kind == "text":
        return f"nullif(trim(left({line}, {cell.most})), '')"
    if cell.kind == "date":
        head = rf"regexp_replace(regexp_extract({low}, '^(\d{{4}}-\d{{1,2}}-\d{{1,2}})(?:[t ].*)?$|^(\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}}))(?: .*)?$|^(\d{{1,2}}[ -][a-z]{{3,9}}[ -](?:\d{{4}}|\d{{2}}))(?: .*)?$', 0), '(\d)t.*$', '\1')"
        day = rf"regexp_replace(regexp_extract({head}, '^[^ ]+ [a-z]+ [0-9]+|^[^ ]+'), '[/. ]', '-', 'g')"
        named = rf"regexp_replace({day}, '^([0-9]+)-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?-', '\1-\2-')"
        full = rf"CASE WHEN regexp_matches({named}, '-[0-9]{{2}}$') AND NOT regexp_matches({named}, '^[0-9]{{4}}-') THEN left({named}, length({named}) - 2) || CASE WHEN CAST(right({named}, 2) AS INTEGER) <= 30 THEN '20' ELSE '19' END || right({named}, 2) ELSE {named} END"
        return f"CAST(coalesce(try_strptime({full}, '%Y-%m-%d'), try_strptime({full}, '%d-%m-%Y'), try_strptime({full}, '%d-%b-%Y')) AS DATE)"
    if cell.kind == "time":
        t = rf"trim(regexp_replace(lower({r}), '^(\d{{4}}-\d{{1,2}}-\d{{1,2}}[t ]|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}} )', ''))"
        h, m = f"CAST(nullif(regexp_extract({t}, '^[0-9]{{1,2}}'), '') AS INTEGER)", rf"coalesce(CAST(nullif(regexp_extract({t}, '^[0-9]{{1,2}}[:.]?([0-9]{{2}})', 1), '') AS INTEGER), 0)"
        half = rf"regexp_matches({t}, 'a\.?m\.?$')", rf"regexp_matches({t}, 'p\.?m\.?$')"
        ok = rf"regexp_full_match({t}, '[0-9]{{4}}|[0-9]{{1,2}}[:.][0-9]{{2}}(:[0-9]{{2}}(\.[0-9]+)?)?\s*(am|pm|a\.m\.|p\.m\.)?|[0-9]{{1,2}}\s*(am|pm|a\.m\.|p\.m\.)')"
        return f"CASE WHEN {ok} AND {m} < 60 AND CASE WHEN {half[0]} OR {half[1]} THEN {h} BETWEEN 1 AND 12 ELSE {h} < 24 END THEN 60 * CASE WHEN {half[0]} THEN {h} % 12 WHEN {half[1]} THEN {h} % 12 + 12 ELSE {h} END + {m} END"
    if cell.kind == "money":
        t = rf"regexp_replace(upper({r}), '\s|£|GBP', '', 'g')"
        return rf"CASE WHEN regexp_full_match({t}, '\(?-?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\.[0-9]{{1,2}})?\)?') AND CAST(regexp_replace({t}, '[-,()]', '', 'g') AS DECIMAL(18, 2)) <= 1000000 THEN CAST(CAST(regexp_replace({t}, '[-,()]', '', 'g') AS DECIMAL(18, 2)) * 100 AS BIGINT) * CASE WHEN contains({t}, '-') <> contains({t}, '(') THEN -1 ELSE 1 END END"
    if cell.kind == "int":
        return rf"CASE WHEN regexp_full_match({r}, '-?[0-9]+') AND CAST({r} AS BIGINT) BETWEEN {cell.least} AND {cell.most} THEN CAST({r} AS BIGINT) END"
    if cell.kind == "yesno":
        return f"CASE WHEN list_contains({_list(C.YES)}, lower({r})) THEN true WHEN list_contains({_list(C.NO)}, lower({r})) THEN false END"
    if cell.kind == "sex":
        return "CASE " + " ".join(f"WHEN list_contains({_list(w)}, lower({r})) THEN '{n}'" for n, w in C.SEXES.items()) + " END"
    if cell.kind == "email":
        return rf"CASE WHEN regexp_full_match(lower({r}), '[^\s@]+@[^\s@]+\.[^\s@]+') THEN lower({r}) END"
    if cell.kind == "phone":
        home = rf"regexp_replace(regexp_replace({r}, '[^0-9+]', '', 'g'), '^(\+44|0044)', '0')"
        return rf"CASE WHEN regexp_full_match({r}, '[+0-9 ()-]{{6,24}}') AND CASE WHEN {r} LIKE '+%' AND {r} NOT LIKE '+44%' THEN length(regexp_replace({r}, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 ELSE regexp_full_match(replace({home}, '+', ''), '0[0-9]{{9,10}}') END THEN {line} END"
    if cell.kind == "postcode":
        t = rf"upper(regexp_replace({r}, '\s', '', 'g'))"
        return rf"CASE WHEN regexp_full_match({t}, '[A-Z]{{1,2}}[0-9][A-Z0-9]?[0-9][A-Z]{{2}}') THEN left({t}, length({t}) - 3) || ' ' || right({t}, 3) END"
    key = f"trim(regexp_replace(replace(strip_accents(lower({r})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    return "CASE " + " ".join(f"WHEN list_contains({_list(w)}, {key}) THEN '{n}'" for n, w in WORDS[cell.kind].items()) + " END"


def _sql_problem(cell: Cell, field: str) -> str:
    r, v = f"r_{field}", f"v_{field}"
    blank = f"WHEN {r} = '' THEN " + (f"'REQUIRED:error:{field}'" if cell.required else "NULL")
    if cell.kind == "text":
        return rf"CASE {blank} WHEN length(trim(regexp_replace({r}, '\s+', ' ', 'g'))) > {cell.most} THEN 'SHORTENED:warning:{field}' END"
    severity = "error" if cell.kind == "time" or cell.required else "warning"
    return f"CASE {blank} WHEN {v} IS NULL THEN '{cell.CODES.get(cell.kind, 'INVALID_VALUE')}:{severity}:{field}' END"


def _oracle(kind: str, *shown: str) -> str:
    name, key = _TABLE[kind]
    steps = [f"t0 AS (SELECT {key} AS row_id, " + ", ".join(f"trim(({_list(t)})[CAST({key} // {1 + n} % {len(t)} + 1 AS INTEGER)]) AS r_{f}" for n, (f, t) in enumerate(_CELLS[kind].items())) + f" FROM {name})"]
    steps.append(f"t1 AS (SELECT *, DATE '{TODAY}' AS today, " + ", ".join(f"{_sql_reader(c, f'r_{f}')} AS v_{f}" for f, c in KINDS[kind].items()) + " FROM t0)")
    steps.append("t2 AS (SELECT *, [" + ", ".join(_sql_problem(c, f) for f, c in KINDS[kind].items()) + "] AS found FROM t1)")
    extra = []
    if kind == "patients":
        title = rf"'(?i)^({'|'.join(C.TITLES)})\.?\s+(\S.*)$'"
        extra.append(rf"SELECT *, trim(regexp_replace(r_fullName, '\s+', ' ', 'g')) AS w, (v_firstName IS NULL OR v_lastName IS NULL) AND r_fullName <> '' AS use_whole FROM t2")
        extra.append(r"SELECT *, CASE WHEN contains(w, ',') THEN trim(regexp_replace(w, '^[^,]*,', '')) ELSE w END AS given FROM ({})")
        extra.append(rf"SELECT *, lower(regexp_extract(given, {title}, 1)) AS tw, lower(regexp_extract(coalesce(v_firstName, ''), {title}, 1)) AS tb FROM ({{}})")
        extra.append(rf"SELECT *, CASE WHEN tw <> '' THEN trim(regexp_extract(given, {title}, 2)) ELSE given END AS rest FROM ({{}})")
        extra.append(r"SELECT *, CASE WHEN contains(w, ',') THEN trim(split_part(w, ',', 1)) WHEN contains(rest, ' ') THEN regexp_extract(rest, '[^ ]+$') ELSE '' END AS wl, CASE WHEN contains(w, ',') THEN rest ELSE regexp_replace(rest, ' ?[^ ]+$', '') END AS wf FROM ({})")
        named = lambda t: f"CASE WHEN {t} = 'professor' THEN 'Prof' WHEN {t} <> '' THEN upper({t}[1]) || {t}[2:] END"
        extra.append(f"SELECT * REPLACE (coalesce(v_title, CASE WHEN name_split THEN {named('tw')} END, CASE WHEN NOT use_whole THEN {named('tb')} END) AS v_title, CASE WHEN NOT use_whole AND v_title IS NULL AND tb <> '' THEN trim(regexp_extract(v_firstName, {title}, 2)) ELSE coalesce(v_firstName, CASE WHEN name_split THEN left(wf, 80) END) END AS v_firstName, coalesce(v_lastName, CASE WHEN name_split THEN left(wl, 80) END) AS v_lastName) FROM (SELECT *, use_whole AND wl <> '' AND wf <> '' AS name_split FROM ({{}}))")
    elif kind == "appointments":
        extra.append(f"SELECT * REPLACE (CASE WHEN r_startTime = '' THEN {_sql_reader(Cell('time'), 'r_date')} ELSE v_startTime END AS v_startTime) FROM t2")
    else:
        extra.append("SELECT * FROM t2")
    body = extra[0]
    for x in extra[1:]:
        body = x.format(body)
    for col, expression in VALUES[kind]:
        body = f"SELECT * REPLACE ({expression} AS {col}) FROM ({body})" if col.startswith("v_") else f"SELECT *, {expression} AS {col} FROM ({body})"
    rules = ", ".join(f"CASE WHEN {test} THEN '{issue}' END" for issue, test in RULES[kind])
    steps.append(f"t3 AS ({body})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT row_id, usable, array_to_string(list_sort(list_filter(list_concat(found, [{rules}]), lambda x: x IS NOT NULL)), ';') AS issues, {', '.join(f'v_{s}' for s in shown)} FROM t3"


def _query(kind: str, *shown: str):
    def run(spark, sf_dir):
        read = read_rows(_made_up(spark, sf_dir, kind), kind, F.lit(TODAY).cast("date"))
        return read.select("row_id", "usable", F.array_join("issues", ";").alias("issues"), *[f"v_{s}" for s in shown])

    run.__name__ = f"import_{kind}"
    run.__doc__ = f"Rows of a made-up file of {kind}: what is read and every issue."
    return query(_oracle(kind, *shown))(run)


import_patients = _query("patients", "ref", "title", "firstName", "lastName", "dateOfBirth", "sex", "email", "phoneMobile", "postcode", "reminderSms", "status")
import_cases = _query("cases", "ref", "title", "openedOn", "closedOn", "status", "payerType", "sessionsAuthorised", "sessionsUsed", "excess")
import_appointments = _query("appointments", "ref", "date", "startTime", "endTime", "durationMinutes", "status", "charge")
import_invoices = _query("invoices", "ref", "issuedOn", "dueOn", "total", "paid", "balance", "payerType", "status")


@query("""SELECT s_suppkey AS ref, 'Site; ' || s_name || chr(10) || 'line "2"' AS name, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation, s_suppkey % 5 = 0 AS bad FROM supplier""")
def csv_import(spark, sf_dir):
    """A semicolon file with a byte-order mark, quoted line breaks and quotes, short rows and rows that are too long."""
    from wardflow.streaming.jobs import work_folder

    at = work_folder(spark, "import")
    k = F.col("s_suppkey")
    cells = F.concat(k.cast("string"), F.lit(';"Site; '), F.col("s_name"), F.lit('\nline ""2"""'), F.when(k % 4 != 0, F.concat(F.lit(";"), F.col("s_nationkey").cast("string"))).otherwise(""), F.when(k % 5 == 0, F.when(k % 4 == 0, ";;x;y").otherwise(";x;y")).otherwise(""))
    supplier = table(spark, sf_dir, "supplier")
    top = F.when(k == supplier.agg(F.min("s_suppkey")).scalar(), "\ufeffref;name;nation\n").otherwise("")
    supplier.select("s_suppkey", F.concat(top, cells).alias("value")).sort("s_suppkey").coalesce(1).select("value").write.option("lineSep", "\n").text(at)
    read = C.read_csv(spark, at)
    return read.select(F.col("ref").cast("long").alias("ref"), "name", F.nullif("nation", F.lit("")).alias("nation"), F.col("_long").alias("bad"))
