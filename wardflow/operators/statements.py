"""What texts state in durations and bands, items of orders, and checks of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.scalars import once
from wardflow.operators.figures import ONES, TEENS, UNITS
from wardflow.operators.repeats import multiset_within
from wardflow.operators.sentence_spans import TERMS
from wardflow.registry import query
from wardflow.sources.tables import table

# ---- durations and bands ----

#: Days of a unit by its first letter, numbers in words, what opens or closes a band.
UNIT_DAYS = {"d": 1.0, "w": 7.0, "m": 30.4375, "y": 365.25}
FEW = {"a": 1, "an": 1} | {w: n for n, w in enumerate([*ONES, *TEENS[:3]], 1)}
_N = rf"(\d+(?:\.\d+)?|{'|'.join(sorted(FEW, key=len, reverse=True))})"
_DUR = rf"{_N}(?:\s*(?:-|–|—|to)\s*{_N})?\s*(days?|weeks?|wks?|months?|mths?|years?|yrs?)"
OVER, UNDER = r"(?:over|more than|greater than|longer than|>)", r"(?:under|less than|fewer than|up to|within|<)"
AFTER = r"\s*(?:\+|or more|and over|plus)"


#: Signs of a text's tokens: what opens a band above or below, what closes one, and what joins a range. Cues of two words are one token.
SIGNS = {"over": ">", "more_than": ">", "greater_than": ">", "longer_than": ">", ">": ">", "under": "<", "less_than": "<", "fewer_than": "<", "up_to": "<", "within": "<", "<": "<", "or_more": "+", "and_over": "+", "plus": "+", "+": "+", "-": "-", "–": "-", "—": "-", "to": "-"}
_PAIRED = [w.split("_") for w in SIGNS if "_" in w]


def _tokens(text: Column) -> Column:
    """Struct (tokens, letters): the tokens of a text, and one letter for each: N a number, U a unit, a sign, or x."""
    t = F.lower(text)
    for first, second in _PAIRED:
        t = F.regexp_replace(t, rf"\b{first}\s+{second}\b", f"{first}_{second}")
    tokens = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?|[a-z_]+|[^\sa-z0-9_])"), F.lit(1))
    table_ = F.create_map(*[F.lit(x) for w, sign in ({w: "N" for w in FEW} | {w: "U" for w in UNITS} | SIGNS).items() for x in (w, sign)])
    letter = lambda w: F.coalesce(F.element_at(table_, w), F.when(w.rlike(r"^\d"), "N").otherwise("x"))
    return once(tokens, lambda found: F.struct(found.alias("tokens"), F.array_join(F.transform(found, letter), "").alias("letters")))


def _length(tokens: Column, at: Column, unit_at: Column) -> Column:
    """Days of the number at a place, in the unit at another."""
    few = F.create_map(*[F.lit(x) for w, n in FEW.items() for x in (w, float(n))])
    days = F.create_map(*[F.lit(x) for w, n in UNIT_DAYS.items() for x in (w, n)])
    word = F.get(tokens, at)
    return F.coalesce(word.try_cast("double"), F.element_at(few, word)) * F.element_at(days, F.substring(F.get(tokens, unit_at), 1, 1))


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def band(text: Column) -> Column:
    """Struct (low, high) of days of a printed band: '0-3 months', 'over 12 months', '12 months +', 'up to 6 weeks'. high is
    null for an open one; null for what is no band."""
    return once(_tokens(F.regexp_replace(F.trim(text), r"\.$", "")), lambda read: _printed(read["tokens"], read["letters"]))


def _printed(tokens: Column, letters: Column) -> Column:
    at = lambda i, u: _length(tokens, F.lit(i), F.lit(u))
    none = F.lit(None).cast("double")
    return (
        F.when((letters == "N-NU") & (at(2, 3) >= at(0, 3)), _span(at(0, 3), at(2, 3)))
        .when(letters == ">NU", _span(at(1, 2), none))
        .when(letters == "NU+", _span(at(0, 1), none))
        .when(letters == "<NU", _span(F.lit(0.0), at(1, 2)))
    )


def quoted_duration(text: Column) -> Column:
    """Struct (low, high) of the one duration that a quoted expectation states; null for none, or for more than one."""
    return once(_tokens(text), lambda read: _quoted(read["tokens"], read["letters"]))


def _quoted(tokens: Column, letters: Column) -> Column:
    form = "N(?:-N)?U"
    before = F.regexp_extract(letters, f"^(.*?){form}", 1)
    i = F.length(before)
    sign, ranged = F.right(before, F.lit(1)), F.substr(letters, i + 2, F.lit(1)) == "-"
    unit = i + F.when(ranged, 3).otherwise(1)
    low, high = _length(tokens, i, unit), _length(tokens, i + 2, unit)
    # a range that runs backwards is no duration
    out = F.when(ranged, F.when(high >= low, _span(low, high))).when(sign == "<", _span(F.lit(0.0), low)).when(sign == ">", _span(low, F.lit(None).cast("double"))).otherwise(_span(low, low))
    return F.when(F.regexp_count(letters, F.lit(form)) == 1, out)


def band_containing(duration: Column, options: list[str]) -> Column:
    """The one option whose band holds the whole duration; null where none or more than one does."""
    # the bands are the same for every row: they are read once, here
    read = SparkSession.active().range(1).select(*[band(F.lit(o)).alias(f"b{n}") for n, o in enumerate(options)]).first()
    top = lambda high: F.coalesce(high, F.lit(float("inf")))
    holds = [(o, (duration["low"] >= b["low"]) & (top(duration["high"]) <= (float("inf") if b["high"] is None else b["high"]))) for o, b in zip(options, read, strict=True) if b]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(o)) for o, test in holds])) if holds else F.array().cast("array<string>")
    return once(hits, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


_OPTIONS = ("0-3 MONTHS", "4 – 6 months", "Over 12 months", "up to 6 weeks", "6 wks", "12 months +", "two to four weeks", "3-1 days", "Less than a year.", "> 2 yrs", "soon", "within 10 days or more", "1.5-2 years", None)
_QUOTES = ("should settle within 4–6 weeks", "about 6 weeks more", "within six weeks", "2 to 3 months", "7 sessions over 6 weeks, review in 4 weeks", "up to 14 months", "over two years", "5 to 2 weeks", "no idea", "more than 3 months", "an hour a day", None)
_BANDS = ["0-3 months", "3-12 months", "Over 12 months"]
_texts = lambda options: "[" + ", ".join("NULL" if o is None else f"'{o}'" for o in options) + "]"
_FEW_SQL = lambda x: f"coalesce(try_cast({x} AS DOUBLE), CASE {x} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in FEW.items()) + " END)"
_UNIT_SQL = lambda x: f"CASE left({x}, 1) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in UNIT_DAYS.items()) + " END"


@query(rf"""WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(({_texts(_OPTIONS)})[CAST(p_partkey % {len(_OPTIONS)} + 1 AS INTEGER)]), '\s+', ' ', 'g')) AS t FROM part),
r AS (SELECT p_partkey, t, regexp_full_match(t, '{_N}\s*(-|–|—|to)\s*{_N}\s*(days?|weeks?|wks?|months?|mths?|years?|yrs?)\.?') AS span, regexp_full_match(t, '{OVER}\s*{_N}\s*(days?|weeks?|wks?|months?|mths?|years?|yrs?)\.?|{_N}\s*(days?|weeks?|wks?|months?|mths?|years?|yrs?){AFTER}\.?') AS above,
regexp_full_match(t, '{UNDER}\s*{_N}\s*(days?|weeks?|wks?|months?|mths?|years?|yrs?)\.?') AS below, regexp_extract_all(regexp_replace(t, '^{OVER}|^{UNDER}', ''), '\b{_N}\b') AS n, {_UNIT_SQL("regexp_extract(t, '(days?|weeks?|wks?|months?|mths?|years?|yrs?)', 1)")} AS u FROM t),
v AS (SELECT p_partkey, span, above, below, {_FEW_SQL("n[1]")} * u AS a, {_FEW_SQL("n[2]")} * u AS b FROM r)
SELECT p_partkey, CASE WHEN span AND b >= a OR above THEN a WHEN below THEN 0.0 END AS low, CASE WHEN span AND b >= a THEN b WHEN below THEN a END AS high FROM v""")
def duration_bands(spark, sf_dir):
    """Printed bands as days."""
    option = F.element_at(F.array(*map(F.lit, _OPTIONS)), (F.col("p_partkey") % len(_OPTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", band(option).alias("b")).select("p_partkey", "b.low", "b.high")


@query(rf"""WITH t AS (SELECT c_custkey, regexp_replace(lower(({_texts(_QUOTES)})[CAST(c_custkey % {len(_QUOTES)} + 1 AS INTEGER)]), '\s+', ' ', 'g') AS t FROM customer),
f AS (SELECT c_custkey, t, regexp_extract_all(t, '((within|under|less than|up to|over|more than) )?\b{_DUR}\b') AS found FROM t),
g AS (SELECT c_custkey, found[1] AS x, regexp_extract(found[1], '^(within|under|less than|up to|over|more than) ', 1) AS lead, regexp_extract(found[1], '{_DUR}', ['a', 'b', 'u']) AS d FROM f WHERE len(found) = 1),
v AS (SELECT c_custkey, lead, {_FEW_SQL("d.a")} * {_UNIT_SQL("d.u")} AS a, {_FEW_SQL("nullif(d.b, '')")} * {_UNIT_SQL("d.u")} AS b FROM g),
h AS (SELECT c_custkey, CASE WHEN b IS NULL AND lead IN ('within', 'under', 'less than', 'up to') THEN 0.0 ELSE a END AS low, CASE WHEN b IS NOT NULL THEN b WHEN lead IN ('over', 'more than') THEN NULL ELSE a END AS high FROM v WHERE b IS NULL OR b >= a)
SELECT c.c_custkey, low, high, CASE WHEN (low >= 0 AND high <= 3 * 30.4375)::INT + (low >= 3 * 30.4375 AND high <= 12 * 30.4375)::INT + (low >= 12 * 30.4375)::INT = 1 OR (high IS NULL AND low >= 12 * 30.4375)
  THEN CASE WHEN high <= 3 * 30.4375 THEN '0-3 months' WHEN low >= 3 * 30.4375 AND high <= 12 * 30.4375 THEN '3-12 months' WHEN low >= 12 * 30.4375 THEN 'Over 12 months' END END AS band
FROM customer c LEFT JOIN h ON h.c_custkey = c.c_custkey""")
def duration_in_band(spark, sf_dir):
    """The duration that a quoted expectation states, and the printed band that holds it whole."""
    quote = F.element_at(F.array(*map(F.lit, _QUOTES)), (F.col("c_custkey") % len(_QUOTES) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", quoted_duration(quote).alias("d"))
    return c.select("c_custkey", "d.low", "d.high", band_containing(F.col("d"), _BANDS).alias("band"))


# ---- items of orders ----


@query("""WITH o AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders),
q AS (SELECT l_orderkey, l_partkey % 7 AS item, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT o.o_orderkey, later, NOT EXISTS (SELECT 1 FROM q a LEFT JOIN q b ON b.l_orderkey = o.later AND b.item = a.item WHERE a.l_orderkey = o.o_orderkey AND a.n > coalesce(b.n, 0)) AS inside FROM o WHERE later IS NOT NULL AND EXISTS (SELECT 1 FROM q WHERE l_orderkey = o_orderkey) AND EXISTS (SELECT 1 FROM q WHERE l_orderkey = later)""")
def multiset_containment(spark, sf_dir):
    """Whether all items of an order, as often as it has them, are in the customer's next order."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("later")).where("later IS NOT NULL")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 7).alias("items"))
    own, next_ = held.select(F.col("l_orderkey").alias("o_orderkey"), F.col("items").alias("a")), held.select(F.col("l_orderkey").alias("later"), F.col("items").alias("b"))
    return o.join(own, "o_orderkey").join(next_, "later").select("o_orderkey", "later", multiset_within(F.col("a"), F.col("b")).alias("inside"))


# ---- validators ----

Validator = Callable[[DataFrame], DataFrame]
#: Checks of texts by name, in the order in which their flags are listed: rows (doc_id, text) to (doc_id, code, severity, evidence).
VALIDATORS: dict[str, Validator] = {}


def validator(name: str) -> Callable[[Validator], Validator]:
    def keep(f: Validator) -> Validator:
        VALIDATORS[name] = f
        return f

    return keep


def run_validators(rows: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """Flags of all checks but those that are off, each with its check's place; one scan of the rows for each check."""
    out = None
    for k, (name, check) in enumerate(VALIDATORS.items()):
        if name not in off:
            flags = check(rows).select("doc_id", F.lit(k).alias("place"), F.lit(name).alias("check_name"), "code", "severity", "evidence")
            out = flags if out is None else out.unionByName(flags)
    return out


def _evidence(form: str, code: str, severity: str) -> Validator:
    def check(rows: DataFrame) -> DataFrame:
        found = rows.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({form})"), F.lit(1)).alias("e"))
        return found.where(F.size("e") > 0).select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("e")[0].alias("evidence"))

    return check


#: Forms of a merge field and of a place that is still to be filled.
MERGE_FIELD = r"«[^«»\n]{1,80}»|<<[^<>\n]{1,80}>>|\{\{[^{}\n]{1,80}\}\}|MERGEFIELD \w+"
PLACEHOLDER = r"\[(?:insert|name|date|tbc|to be confirmed)[^\]\n]{0,60}\]|\bTBC\b|_{4,}|\bXX+\b"
validator("placeholders")(_evidence(PLACEHOLDER, "MISSING_PLACEHOLDER", "blocking"))
validator("merge-fields")(_evidence(MERGE_FIELD, "MISSING_PLACEHOLDER", "blocking"))
validator("terms")(_evidence(rf"(?i)\b(?:{'|'.join(TERMS)})\b", "EXCLUDED_TERM", "warning"))


@validator("gaps")
def _empty(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("doc_id", F.lit("EMPTY").alias("code"), F.lit("blocking").alias("severity"), F.lit("").alias("evidence"))


@validator("draft-fit")
def _long(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("text") > 4000).select("doc_id", F.lit("TOO_LONG").alias("code"), F.lit("warning").alias("severity"), F.length("text").cast("string").alias("evidence"))


_FILLED = ("", " Dear «Name», ", " [insert date] ", " <<P_REF>> ____ ", " {{site}} TBC ")
_flag = lambda k, name, code, severity, form: rf"SELECT doc_id, {k} AS place, '{name}' AS check_name, '{code}' AS code, '{severity}' AS severity, regexp_extract_all(t, '{form}')[1] AS evidence FROM d WHERE regexp_matches(t, '{form}')"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN ' ' ELSE coalesce(text, '') || ([{", ".join(map(repr, _FILLED))}])[CAST(doc_id % 5 + 1 AS INTEGER)] END AS t FROM documents)
""" + " UNION ALL ".join([_flag(0, "placeholders", "MISSING_PLACEHOLDER", "blocking", PLACEHOLDER), _flag(1, "merge-fields", "MISSING_PLACEHOLDER", "blocking", MERGE_FIELD), _flag(2, "terms", "EXCLUDED_TERM", "warning", rf"(?i)\b(?:{'|'.join(TERMS)})\b"), "SELECT doc_id, 3, 'gaps', 'EMPTY', 'blocking', '' FROM d WHERE trim(t) = ''", "SELECT doc_id, 4, 'draft-fit', 'TOO_LONG', 'warning', CAST(length(t) AS VARCHAR) FROM d WHERE length(t) > 4000"]))
def validator_flags(spark, sf_dir):
    """Flags of all checks over documents whose texts got fields and gaps put in."""
    fill = F.element_at(F.array(*map(F.lit, _FILLED)), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 50 == 7, " ").otherwise(F.concat(F.coalesce("text", F.lit("")), fill))
    return run_validators(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
