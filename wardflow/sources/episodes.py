"""Episode imports: files of one patient's notes as JSON, CSV or plain text, to rows of notes, visits and scores with issues.

A file is one value (`content`); what it holds becomes rows by exploding, so a file's size is bounded by its own text. The
limits on a file are parameters, and a file beyond them gets an issue and no rows: TOO_LONG, TOO_MANY_NOTES. A CSV row with more cells than the header
is left out with ROW_TOO_LONG, and of two equal headers the first one holds, with HEADER_TWICE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators import cleaning as C
from wardflow.registry import query
from wardflow.sources.tables import table

MOST_CHARS = 2_000_000
MOST_NOTES = 500
#: Visit codes of the files and what they stand for; prefixes of a note's parts.
VISIT_CODES = {"ATT": "attended", "DNA": "did_not_attend", "LCN": "late_cancellation", "CNC": "cancelled", "BOOKED": "booked"}
PARTS = {"S": "subjective", "O": "objective", "A": "assessment", "P": "plan"}
_NOTE = "struct<date:string,type:string,author:string,subjective:string,objective:string,assessment:string,plan:string>"
SCHEMA = f"struct<registration:struct<first_name:string,last_name:string,date_of_birth:string>,notes:array<{_NOTE}>,appointments:array<struct<date:string,start_time:string,duration:int,status:string>>,outcome_measures:array<struct<name:string,scores:array<struct<date:string,value:double>>>>>"


def read_json(files: DataFrame, key: str, most_notes: int = MOST_NOTES, most_chars: int = MOST_CHARS) -> dict[str, DataFrame]:
    """From (key, content): notes (key, n, day, kind, author, and the parts), visits, scores and issues (key, code, at)."""
    read = files.select(key, F.length("content").alias("chars"), F.from_json("content", SCHEMA, {"mode": "PERMISSIVE"}).alias("b"))
    read = read.withColumn("broken", F.coalesce(F.col("b.registration").isNull() & F.col("b.notes").isNull() & F.col("b.appointments").isNull() & F.col("b.outcome_measures").isNull(), F.lit(True)))
    long = F.col("chars") > most_chars
    fit = read.where(~long & ~F.col("broken") & (F.coalesce(F.size("b.notes"), F.lit(0)) <= most_notes))
    notes = fit.select(key, F.posexplode("b.notes").alias("n", "x")).select(key, "n", C.read_date(F.col("x.date")).alias("day"), F.col("x.type").alias("kind"), "x.author", *[f"x.{p}" for p in PARTS.values()])
    code = F.upper(F.trim("x.status"))
    visits = fit.select(key, F.posexplode("b.appointments").alias("n", "x")).select(key, "n", C.read_date(F.col("x.date")).alias("day"), C.read_time(F.col("x.start_time")).alias("minute"), "x.duration", F.coalesce(*[F.when(code == c, F.lit(v)) for c, v in VISIT_CODES.items()]).alias("outcome"))
    scores = fit.select(key, F.explode("b.outcome_measures").alias("m")).select(key, F.col("m.name").alias("measure"), F.posexplode("m.scores").alias("n", "x")).select(key, "measure", "n", C.read_date(F.col("x.date")).alias("day"), F.round(F.col("x.value") * 10).cast("long").alias("tenths"))
    issue = lambda rows, code, at: rows.select(key, F.lit(code).alias("code"), at.alias("at"))
    issues = issue(read.where(long), "TOO_LONG", F.lit(-1)).unionByName(issue(read.where(~F.coalesce(long, F.lit(False)) & F.col("broken")), "NOT_READABLE", F.lit(-1))).unionByName(issue(read.where(~long & ~F.col("broken") & F.coalesce(F.size("b.notes") > most_notes, F.lit(False))), "TOO_MANY_NOTES", F.lit(-1)))
    issues = issues.unionByName(issue(notes.where("day IS NULL"), "NOTE_DATE", F.col("n"))).unionByName(issue(visits.where("day IS NULL"), "VISIT_DATE", F.col("n"))).unionByName(issue(visits.where("outcome IS NULL"), "VISIT_STATUS", F.col("n")))
    return {"notes": notes, "visits": visits, "scores": scores, "issues": issues}


_BREAK, _COMMA = "\x01", "\x02"


def _shielded(content: Column) -> Column:
    """The text with line breaks and commas inside quotes replaced: what lies between an odd quote and the next one is quoted."""
    quoted = lambda x: F.replace(F.replace(x, F.lit("\n"), F.lit(_BREAK)), F.lit(","), F.lit(_COMMA))
    return F.array_join(F.transform(F.split(content, '"'), lambda x, i: F.when(i % 2 == 1, quoted(x)).otherwise(x)), '"')


def _cells(line: Column) -> Column:
    """Cells of a shielded CSV line."""
    bare = lambda p: F.replace(F.regexp_replace(F.trim(p), '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.split(line, ","), lambda p: F.replace(F.replace(bare(p), F.lit(_BREAK), F.lit("\n")), F.lit(_COMMA), F.lit(",")))


def read_csv_notes(files: DataFrame, key: str, most_chars: int = MOST_CHARS) -> dict[str, DataFrame]:
    """From (key, content): facts of '# name: value' lines (key, name, value), rows as maps of header to cell (key, n, row), and issues
    (key, code, at). Cells may hold quoted commas and line breaks; `at` is the row, or the place of the header that stands twice."""
    fit, long = files.where(F.length("content") <= most_chars), files.where(F.length("content") > most_chars)
    lines = F.filter(F.split(_shielded(F.col("content")), r"\r?\n"), lambda x: F.trim(x) != "")
    cut = fit.select(key, lines.alias("lines")).select(key, F.filter("lines", lambda x: x.startswith("#")).alias("meta"), F.filter("lines", lambda x: ~x.startswith("#")).alias("rows"))
    form = r"^#\s*([^:]+?)\s*:\s*(.*)$"
    plain = F.replace(F.replace(F.col("l"), F.lit(_BREAK), F.lit("\n")), F.lit(_COMMA), F.lit(","))
    facts = cut.select(key, F.explode("meta").alias("l")).where(F.col("l").rlike(form)).select(key, F.lower(F.regexp_extract(plain, form, 1)).alias("name"), F.regexp_extract(plain, form, 2).alias("value"))
    head = F.transform(_cells(F.get("rows", F.lit(0))), lambda h: F.lower(h))
    headed = cut.where(F.size("rows") > 0).select(key, head.alias("head"), "rows")
    rows = headed.select(key, "head", F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("n", "l"))
    width = F.size("head")
    cells = rows.select(key, "n", "head", _cells(F.col("l")).alias("cells"))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    first = F.filter(F.arrays_zip("head", padded.alias("cell")), lambda x, i: F.array_position(F.col("head"), x["head"]) == i + 1)
    issue = lambda df, code, at: df.select(key, F.lit(code).alias("code"), at.cast("int").alias("at"))
    twice = headed.select(key, F.posexplode("head").alias("i", "h"), "head").where(F.array_position(F.col("head"), F.col("h")) < F.col("i") + 1)
    issues = issue(long, "TOO_LONG", F.lit(-1)).unionByName(issue(cells.where(F.size("cells") > width), "ROW_TOO_LONG", F.col("n"))).unionByName(issue(twice, "HEADER_TWICE", F.col("i")))
    return {"facts": facts, "rows": cells.where(F.size("cells") <= width).select(key, "n", F.map_from_entries(first).alias("row")), "issues": issues}


def read_text_notes(files: DataFrame, key: str) -> DataFrame:
    """From (key, content): notes (key, n, day, heading, and the parts): a note begins at each line that starts with a date; a
    line 'S: ...' begins a part, and other lines go on with the part they stand in. One key is one file."""
    lines = files.select(key, F.posexplode(F.split("content", r"\r?\n")).alias("at", "l")).where(F.trim("l") != "")
    head = r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d{2}-\d{2})(?:\s+(.*))?$"
    part = r"^([SOAP]):\s*(.*)$"
    day = F.when(F.col("l").rlike(head), C.read_date(F.regexp_extract("l", head, 1)))
    w = Window.partitionBy(key).orderBy("at")
    tagged = lines.withColumn("day", day).withColumn("n", F.sum(F.col("day").isNotNull().cast("int")).over(w))
    tagged = tagged.withColumn("own", F.when(F.col("day").isNotNull(), "H").otherwise(F.nullif(F.regexp_extract("l", part, 1), F.lit(""))))
    tagged = tagged.withColumn("part", F.last("own", ignorenulls=True).over(w)).where("n > 0")
    said = F.when(F.col("day").isNotNull(), F.regexp_extract("l", head, 2)).when(F.col("own").isNotNull(), F.regexp_extract("l", part, 2)).otherwise(F.trim("l"))
    text = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("at", said.alias("t"))))), lambda x: x["t"]), " ")
    out = tagged.groupBy(key, "n").agg(F.max("day").alias("day"), text("H").alias("heading"), *[text(p).alias(name) for p, name in PARTS.items()])
    return out.withColumn("n", (F.col("n") - 1).cast("int"))


# ---- made-up files, written alike by Spark and by SQL ----

_JSON = """'{"registration":{"first_name":"Ann","last_name":"' || s_name || '"},"notes":[{"date":"' || CASE k % 3 WHEN 0 THEN '03/04/2026' WHEN 1 THEN '2026-04-03T10:00' ELSE 'soon' END || '","type":"initial","subjective":"knee ' || k || '"},{"date":"4 Apr 2026","type":"review","author":"Dr Li","plan":"rest"}],"appointments":[{"date":"2026-04-0' || (k % 9 + 1) || '","start_time":"' || CASE k % 2 WHEN 0 THEN '9:30' ELSE '2.15pm' END || '","duration":' || (k % 3 * 15 + 15) || ',"status":"' || CASE k % 4 WHEN 0 THEN 'ATT' WHEN 1 THEN 'dna' WHEN 2 THEN 'LCN' ELSE 'WHO' END || '"}],"outcome_measures":[{"name":"NDI","scores":[{"date":"2026-04-03","value":' || (k % 50) || '.5},{"date":"x","value":7}]}]}'"""
_CONTENT = f"CASE WHEN k % 7 = 6 THEN 'not json ' || k ELSE {_JSON} END"


def _json_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_CONTENT).alias("content"))


_JSON_SQL = f"WITH f AS (SELECT k, content FROM (SELECT k, {_CONTENT} AS content FROM (SELECT s_suppkey AS k, s_name FROM supplier)) WHERE json_valid(content)), bad AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 = 6)\n"
_DAY = "CASE WHEN {x} = '03/04/2026' OR {x} LIKE '2026-04-03T%' THEN DATE '2026-04-03' WHEN {x} = '4 Apr 2026' THEN DATE '2026-04-04' ELSE try_cast({x} AS DATE) END"
_NOTES_SQL = "SELECT k, CAST(n AS INTEGER) AS n, json_extract_string(content, '$.notes[' || n || '].date') AS d, json_extract_string(content, '$.notes[' || n || '].type') AS kind, json_extract_string(content, '$.notes[' || n || '].author') AS author, json_extract_string(content, '$.notes[' || n || '].subjective') AS subjective, json_extract_string(content, '$.notes[' || n || '].plan') AS plan FROM f, (SELECT unnest([0, 1]) AS n)"


@query(_JSON_SQL + f"SELECT k, n, {_DAY.format(x='d')} AS day, kind, author, subjective, plan FROM ({_NOTES_SQL})")
def episode_json_notes(spark, sf_dir):
    """Notes of JSON files."""
    return read_json(_json_files(spark, sf_dir), "k")["notes"].select("k", "n", "day", "kind", "author", "subjective", "plan")


@query(_JSON_SQL + """SELECT k, 0 AS n, CAST(json_extract_string(content, '$.appointments[0].date') AS DATE) AS day, CASE json_extract_string(content, '$.appointments[0].start_time') WHEN '9:30' THEN 570 ELSE 855 END AS minute, CAST(json_extract_string(content, '$.appointments[0].duration') AS INTEGER) AS duration,
CASE upper(json_extract_string(content, '$.appointments[0].status')) WHEN 'ATT' THEN 'attended' WHEN 'DNA' THEN 'did_not_attend' WHEN 'LCN' THEN 'late_cancellation' END AS outcome FROM f""")
def episode_json_visits(spark, sf_dir):
    """Visits of JSON files."""
    return read_json(_json_files(spark, sf_dir), "k")["visits"]


@query(_JSON_SQL + f"SELECT k, 'NOT_READABLE' AS code, -1 AS at FROM bad UNION ALL SELECT k, 'NOTE_DATE', n FROM ({_NOTES_SQL}) WHERE ({_DAY.format(x='d')}) IS NULL UNION ALL SELECT k, 'VISIT_STATUS', 0 FROM f WHERE json_extract_string(content, '$.appointments[0].status') NOT IN ('ATT', 'dna', 'LCN')")
def episode_json_issues(spark, sf_dir):
    """What could not be read of JSON files."""
    return read_json(_json_files(spark, sf_dir), "k")["issues"]


@query(_JSON_SQL + "SELECT k, 'NDI' AS measure, CAST(n AS INTEGER) AS n, try_cast(json_extract_string(content, '$.outcome_measures[0].scores[' || n || '].date') AS DATE) AS day, CAST(round(CAST(json_extract_string(content, '$.outcome_measures[0].scores[' || n || '].value') AS DOUBLE) * 10) AS BIGINT) AS tenths FROM f, (SELECT unnest([0, 1]) AS n)")
def episode_json_scores(spark, sf_dir):
    """Scores of JSON files."""
    return read_json(_json_files(spark, sf_dir), "k")["scores"]


_CSV = "'# Patient: ' || s_name || chr(10) || '# ref : R' || k || chr(10) || 'Date,Type,Subjective,Status' || chr(10) || '2026-04-03,initial,\"knee, left ' || k || '\",ATT' || chr(13) || chr(10) || chr(10) || '2026-04-0' || (k % 9 + 1) || ',review' || chr(10) || 'a,b,c,d,e' || chr(10)"


@query(f"""WITH f AS (SELECT k, {_CSV} AS content FROM (SELECT s_suppkey AS k, s_name FROM supplier)), l AS (SELECT k, unnest(list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))) AS l, generate_subscripts(list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x) <> '' AND NOT starts_with(x, '#')), 1) - 2 AS n FROM f),
c AS (SELECT k, n, list_transform(regexp_extract_all(l, '("[^"]*"|[^,]+)'), lambda x: trim(x, '"')) AS c FROM l WHERE n >= 0)
SELECT k, n, c[1] AS date, c[2] AS type, coalesce(c[3], '') AS subjective, coalesce(c[4], '') AS status FROM c WHERE len(c) <= 4""")
def episode_csv_rows(spark, sf_dir):
    """Rows of CSV files: quoted commas, short rows filled, rows that are too long left out."""
    f = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_CSV).alias("content"))
    rows = read_csv_notes(f, "k")["rows"]
    return rows.select("k", F.col("n").cast("long").alias("n"), *[F.col("row")[c].alias(c) for c in ("date", "type", "subjective", "status")])


@query("SELECT s_suppkey AS k, 'ROW_TOO_LONG' AS code, 2 AS at FROM supplier UNION ALL SELECT s_suppkey, 'HEADER_TWICE', 4 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'TOO_LONG', -1 FROM supplier WHERE s_suppkey % 10 = 0")
def episode_csv_issues(spark, sf_dir):
    """What was left out of CSV files; every third file has a header twice, and every tenth comes again, longer than may be."""
    k = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").withColumn("k", k).select("k", F.expr(_CSV).alias("content"))
    twice = f.withColumn("content", F.when(F.col("k") % 3 == 0, F.replace("content", F.lit("Status\n"), F.lit("Status,TYPE\n"))).otherwise(F.col("content")))
    long = f.where("k % 10 = 0").withColumn("content", F.rpad("content", 5_000, " "))
    return read_csv_notes(twice.withColumn("content", F.replace("content", F.lit("a,b,c,d,e"), F.lit("a,b,c,d,e,f"))).unionByName(long), "k", 4_000)["issues"]


@query(f"WITH f AS (SELECT k, {_CSV} AS content FROM (SELECT s_suppkey AS k, s_name FROM supplier)) SELECT k, 'patient' AS name, regexp_extract(content, '# Patient: ([^\\n]*)', 1) AS value FROM f UNION ALL SELECT k, 'ref', regexp_extract(content, '# ref : ([^\\n]*)', 1) FROM f")
def episode_csv_facts(spark, sf_dir):
    """Facts that stand above the rows of CSV files."""
    f = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_CSV).alias("content"))
    return read_csv_notes(f, "k")["facts"]


_TEXT = "'Printed for ' || s_name || chr(10) || '03/04/2026 Initial with Dr Li' || chr(10) || 'S: knee pain ' || k || chr(10) || 'worse at night' || chr(10) || 'O: full range' || chr(10) || 'P: rest' || chr(10) || chr(10) || '2026-04-0' || (k % 9 + 1) || chr(10) || 'seen briefly' || CASE WHEN k % 2 = 0 THEN chr(10) || 'A: better' ELSE '' END"


@query(f"""WITH f AS (SELECT k, {_TEXT} AS content FROM (SELECT s_suppkey AS k, s_name FROM supplier)), l AS (SELECT k, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM f),
t AS (SELECT *, regexp_matches(l, '^([0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})( |$)') AS head FROM l WHERE trim(l) <> ''),
u AS (SELECT *, sum(head::INT) OVER (PARTITION BY k ORDER BY pos) AS n, CASE WHEN head THEN 'H' ELSE nullif(regexp_extract(l, '^([SOAP]):', 1), '') END AS own FROM t),
v AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos) AS part, CASE WHEN head THEN regexp_replace(l, '^[^ ]+ ?', '') WHEN own IS NOT NULL THEN regexp_replace(l, '^.: *', '') ELSE trim(l) END AS said FROM u WHERE n > 0)
SELECT k, CAST(n - 1 AS INTEGER) AS n, max(CASE WHEN head THEN coalesce(try_cast(left(l, 10) AS DATE), DATE '2026-04-03') END) AS day, {", ".join(f"coalesce(string_agg(said, ' ' ORDER BY pos) FILTER (part = '{p}'), '') AS {name}" for p, name in (("H", "heading"), *PARTS.items()))} FROM v GROUP BY k, n""")
def episode_text_notes(spark, sf_dir):
    """Notes of plain text files, by dates at the start of lines and by part."""
    f = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_TEXT).alias("content"))
    return read_text_notes(f, "k")


_SCORE = r"\b(ndi|odi|nprs|psfs|quickdash)\s*[:=]?\s*(\d{1,3}(?:\.\d)?)"


def read_text_scores(files: DataFrame, key: str) -> DataFrame:
    """From (key, content): scores (key, measure, tenths) of lines that begin with 'Outcome measures:', 'Outcomes:' or 'Scores:'."""
    lines = files.select(key, F.explode(F.split("content", r"\r?\n")).alias("l")).where(F.lower("l").rlike(r"^\s*(?:outcome measures|outcomes|scores)\s*:"))
    found = lines.select(key, F.explode(F.regexp_extract_all(F.lower("l"), F.lit(f"({_SCORE})"), F.lit(1))).alias("x"))
    return found.select(key, F.regexp_extract("x", _SCORE, 1).alias("measure"), F.round(F.regexp_extract("x", _SCORE, 2).cast("double") * 10).cast("long").alias("tenths"))


_SCORED = "'NDI 10 is not a score line' || chr(10) || '  Outcome measures: NDI ' || (k % 50) || '%, QuickDASH: ' || (k % 90) || '.5 and NPRS ' || (k % 10) || '/10' || chr(10) || 'Scores: PSFS = 6'"


@query(f"""WITH f AS (SELECT k, {_SCORED} AS content FROM (SELECT s_suppkey AS k FROM supplier)), l AS (SELECT k, unnest(string_split(lower(content), chr(10))) AS l FROM f),
x AS (SELECT k, unnest(regexp_extract_all(l, '\\b(?:ndi|odi|nprs|psfs|quickdash)\\s*[:=]?\\s*[0-9]{{1,3}}(?:\\.[0-9])?')) AS x FROM l WHERE regexp_matches(l, '^\\s*(outcome measures|outcomes|scores)\\s*:'))
SELECT k, regexp_extract(x, '^[a-z]+') AS measure, CAST(round(CAST(regexp_extract(x, '[0-9.]+$') AS DOUBLE) * 10) AS BIGINT) AS tenths FROM x""")
def episode_text_scores(spark, sf_dir):
    """Scores that plain text files give in lines of their own."""
    f = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_SCORED).alias("content"))
    return read_text_scores(f, "k")


def visits_of_rows(rows: DataFrame, key: str) -> DataFrame:
    """Visits of CSV rows with a status (key, n, day, minute, outcome); a row of no known status is none."""
    cell = lambda c: F.coalesce(F.col("row")[c], F.lit(""))
    code = F.upper(F.trim(cell("status")))
    outcome = F.coalesce(*[F.when(code == c, F.lit(v)) for c, v in VISIT_CODES.items()])
    return rows.where(outcome.isNotNull()).select(key, "n", C.read_date(cell("date")).alias("day"), C.read_time(cell("time")).alias("minute"), outcome.alias("outcome"))


@query("SELECT s_suppkey AS k, 0 AS n, DATE '2026-04-03' AS day, CAST(NULL AS INTEGER) AS minute, 'attended' AS outcome FROM supplier")
def episode_csv_visits(spark, sf_dir):
    """Visits of CSV files: rows that have a status."""
    f = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).select("k", F.expr(_CSV).alias("content"))
    return visits_of_rows(read_csv_notes(f, "k")["rows"], "k")
