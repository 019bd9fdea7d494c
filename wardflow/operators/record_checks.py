"""Checks of an episode's record, as rows of codes with the items they are about; the search of a code table; and the shortest
span of a source that says what a claim says.

Checks are grouped conditions, one code an episode at most, worst first. Code search goes through an index of the words' beginnings. A claim
meets a source on the stems that both hold; the shortest span of a source sentence that holds all of a claim's stems comes from one fold over their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators.sentence_spans import sentences_sql, split_sentences
from wardflow.registry import query
from wardflow.sources.tables import table

# Words that show what came before an incident, words that explain a missed visit.
BEFORE = [
    r"\bPMH\b",
    r"\bpast (?:medical )?history\b",
    r"\bmedical history\b",
    r"\bprevious(?:ly)? (?:history|episodes?|injur(?:y|ies)|problems?|symptoms?|treatment|surgery|operations?|neck|back|shoulder|knee|hip|ankle|wrist|elbow|spinal|lumbar|cervical|whiplash|accidents?|RTAs?|conditions?|complaints?|pain)\b",
    r"\bprior (?:history|episodes?|injur(?:y|ies)|problems?|symptoms?|treatment|surgery|neck|back|shoulder|conditions?|complaints?|pain|to (?:the|this) (?:accident|incident|injury))\b",
    r"\bpre-?(?:accident|incident|injury|existing)\b",
    r"\bno (?:relevant |significant )?(?:history|hx)\b",
    r"\bnil (?:relevant|significant|of note|PMH)\b",
    r"\b(?:asymptomatic|symptom-free|pain-free|fully fit) (?:before|prior to) (?:the|this) (?:accident|incident|injury)\b",
]
MISSED = r"\b(?:DNA|did not attend|didn't attend|failed to attend|non-attendance|missed (?:the |her |his |their |last |previous )?(?:appointment|session|visit))\b"
#: Codes in the order in which an episode lists them: the worst first, then as they are worked out.
CODES = [("CONSENT_NOT_RECORDED", "blocking"), ("NO_PRE_INCIDENT_HISTORY", "warning"), ("DNA_WITHOUT_REASON", "warning"), ("NO_DISCHARGE_NOTE", "warning"), ("SINGLE_TIMEPOINT_OUTCOME", "warning"), ("INCIDENT_DATE_MISSING", "warning"), ("EPISODE_STILL_OPEN", "info"), ("MULTIPLE_CLINICIANS", "info")]


def record_checks(episodes: DataFrame, notes: DataFrame, visits: DataFrame, series: DataFrame) -> DataFrame:
    """(episode, place, code, severity, about) of episodes (episode, status, consent, incident, incident_day, referral) with notes (episode,
    note_id, day, kind, author, history, text), visits (episode, visit_id, day, missed, reason) and outcome series (episode, series_id, points). about: ids, in order of day and id.

    A null consent is none; a null incident is no incident; a note without a day comes first and explains no missed visit; rows of no known episode are left out.
    """
    text = F.coalesce("text", F.lit(""))
    told = notes.select("episode", "note_id", "day", "kind", F.lower(F.trim("author")).alias("author"), ((F.trim(F.coalesce("history", F.lit(""))) != "") | text.rlike("(?i)" + "|".join(BEFORE))).alias("before"), F.when(text.rlike("(?i)" + MISSED), F.col("day")).alias("explains"))
    first = F.min(F.struct("day", "note_id", "author"))
    of = told.groupBy("episode").agg(
        F.bool_or("before").alias("before"),
        F.max("explains").alias("explained"),
        F.bool_or(F.col("kind") == "discharge").alias("discharged"),
        F.max(F.struct("day", "note_id"))["note_id"].alias("last_note"),
        first["note_id"].alias("first_note"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "initial_assessment", F.struct("day", "note_id"))))["note_id"].alias("initial"),
        first["author"].alias("lead"),
        F.array_sort(F.collect_list(F.struct("day", "note_id", "author"))).alias("by"),
    )
    missing = visits.where(F.col("missed") & (F.trim(F.coalesce("reason", F.lit(""))) == "")).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("day", "visit_id"))).alias("unexplained"))
    single = series.where("points = 1").groupBy("episode").agg(F.array_sort(F.collect_list("series_id")).alias("single"))
    e = episodes.join(of, "episode", "left").join(missing, "episode", "left").join(single, "episode", "left")
    ids = lambda a: F.transform(a, lambda x: x.cast("string"))
    none = F.array().cast("array<string>")
    gone = F.filter("unexplained", lambda v: F.coalesce(F.col("explained") < v["day"], F.lit(True)))
    others = F.filter("by", lambda n: ~n["author"].eqNullSafe(F.col("lead")))
    said = {
        "CONSENT_NOT_RECORDED": (~F.coalesce("consent", F.lit(False)), none),
        "NO_PRE_INCIDENT_HISTORY": (~F.col("before"), F.when(F.size("initial") > 0, ids(F.col("initial"))).otherwise(F.array(F.col("first_note").cast("string")))),
        "DNA_WITHOUT_REASON": (F.size(gone) > 0, ids(gone["visit_id"])),
        "NO_DISCHARGE_NOTE": ((F.col("status") != "open") & ~F.coalesce("discharged", F.lit(False)), F.when(F.col("last_note").isNotNull(), F.array(F.col("last_note").cast("string"))).otherwise(none)),
        "SINGLE_TIMEPOINT_OUTCOME": (F.size("single") > 0, ids(F.col("single"))),
        "INCIDENT_DATE_MISSING": (F.when(F.col("incident").isNotNull(), F.col("incident_day").isNull()).otherwise(F.col("referral").isin("solicitor", "insurer")), none),
        "EPISODE_STILL_OPEN": (F.col("status") == "open", none),
        "MULTIPLE_CLINICIANS": (F.size(others) > 0, ids(others["note_id"])),
    }
    found = F.array_compact(F.array(*[F.when(said[code][0], F.struct(F.lit(k).alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), said[code][1].alias("about"))) for k, (code, severity) in enumerate(CODES)]))
    return e.select("episode", F.explode(found).alias("c")).select("episode", "c.*")


_NOTE_ENDS = {0: " PMH: asthma.", 1: " No relevant history.", 2: " Pain-free before the accident.", 5: " She missed her appointment."}
_end = lambda k: f"CASE {k} % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in _NOTE_ENDS.items()) + " ELSE '' END"
_EPISODES = "conv_id AS episode, CASE WHEN conv_id % 4 = 0 THEN 'open' ELSE 'discharged' END AS status, CASE WHEN conv_id % 5 > 0 THEN conv_id % 5 < 4 END AS consent, CASE WHEN conv_id % 3 > 0 THEN 'accident' END AS incident, CASE WHEN conv_id % 7 > 1 THEN DATE '2024-01-01' END AS incident_day, CASE conv_id % 3 WHEN 0 THEN 'solicitor' ELSE 'gp' END AS referral"
_NOTES = f"conv_id AS episode, turn AS note_id, CAST(DATE '2024-01-01' + CAST(turn AS INTEGER) * 3 AS DATE) AS day, CASE WHEN turn = 0 THEN 'initial_assessment' WHEN turn = 5 THEN 'discharge' ELSE 'review' END AS kind, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'dr elm' END AS author, CAST(NULL AS VARCHAR(9)) AS history, concat(text, {_end('(conv_id * 3 + turn)')}) AS text"
_VISITS = "user_id % 100 AS episode, event_id AS visit_id, CAST(ts AS DATE) AS day, event_type = 'error' AS missed, CASE WHEN event_id % 4 = 0 THEN 'ill' END AS reason"
_rx = lambda x: x.replace("'", "''")


@query(f"""WITH e AS (SELECT DISTINCT {_EPISODES} FROM conversations), n AS (SELECT {_NOTES} FROM conversations), v AS (SELECT {_VISITS} FROM events WHERE event_type = 'error'),
s AS (SELECT conv_id AS episode, role AS series_id, count(*) AS points FROM conversations GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN regexp_matches(text, '(?i){_rx(MISSED)}') THEN day END AS explains, regexp_matches(text, '(?i){_rx("|".join(BEFORE))}') AS before FROM n),
g AS (SELECT episode, bool_or(before) AS before, max(explains) AS explained, bool_or(kind = 'discharge') AS discharged FROM f GROUP BY 1),
w AS (SELECT v.episode, list(CAST(visit_id AS VARCHAR) ORDER BY day, visit_id) AS about FROM v LEFT JOIN g USING (episode) WHERE reason IS NULL AND (explained IS NULL OR explained < day) GROUP BY 1),
o AS (SELECT n.episode, list(CAST(note_id AS VARCHAR) ORDER BY day, note_id) AS about FROM n JOIN (SELECT episode, arg_min(author, note_id) AS lead FROM n GROUP BY 1) l ON l.episode = n.episode AND lead <> author GROUP BY 1),
found AS (SELECT episode, 0 AS place, 'CONSENT_NOT_RECORDED' AS code, 'blocking' AS severity, []::VARCHAR[] AS about FROM e WHERE NOT coalesce(consent, false)
UNION ALL SELECT episode, 1, 'NO_PRE_INCIDENT_HISTORY', 'warning', (SELECT CASE WHEN count(*) FILTER (kind = 'initial_assessment') > 0 THEN list(CAST(note_id AS VARCHAR) ORDER BY note_id) FILTER (kind = 'initial_assessment') ELSE [CAST(min(note_id) AS VARCHAR)] END FROM n WHERE n.episode = g.episode) FROM g WHERE NOT before
UNION ALL SELECT w.episode, 2, 'DNA_WITHOUT_REASON', 'warning', about FROM w JOIN e USING (episode)
UNION ALL SELECT e.episode, 3, 'NO_DISCHARGE_NOTE', 'warning', [(SELECT CAST(max(note_id) AS VARCHAR) FROM n WHERE n.episode = e.episode)] FROM e JOIN g USING (episode) WHERE status <> 'open' AND NOT discharged
UNION ALL SELECT episode, 4, 'SINGLE_TIMEPOINT_OUTCOME', 'warning', list(series_id ORDER BY series_id) FROM s WHERE points = 1 GROUP BY 1
UNION ALL SELECT episode, 5, 'INCIDENT_DATE_MISSING', 'warning', [] FROM e WHERE CASE WHEN incident IS NOT NULL THEN incident_day IS NULL ELSE referral = 'solicitor' END
UNION ALL SELECT episode, 6, 'EPISODE_STILL_OPEN', 'info', [] FROM e WHERE status = 'open'
UNION ALL SELECT episode, 7, 'MULTIPLE_CLINICIANS', 'info', about FROM o)
SELECT episode, place, code, severity, array_to_string(about, ',') AS about FROM found""")
def episode_data_checks(spark, sf_dir):
    """Conversations stand for episodes, their turns for notes, failed events for missed visits, and roles for outcome series."""
    c = table(spark, sf_dir, "conversations")
    plain = lambda s: [F.expr(x) for x in _top(s)]
    visits = table(spark, sf_dir, "events").where("event_type = 'error'").select(*plain(_VISITS))
    series = c.groupBy(F.col("conv_id").alias("episode"), F.col("role").alias("series_id")).agg(F.count("*").alias("points"))
    out = record_checks(c.select(*plain(_EPISODES)).distinct(), c.select(*plain(_NOTES)), visits, series)
    return out.withColumn("about", F.array_join("about", ","))


def _top(fields: str) -> list[str]:
    """Select expressions of a list, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for ch in fields.replace("VARCHAR(9)", "STRING"):
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return out


# ---- search of a code table ----


def search_codes(codes: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """(asked, rank, code): entries of codes (code, label, place) for each search (asked), as their list has them, at most so many. An entry is found if its
    code begins with what is asked, points aside, or if its label holds every word asked; nothing asked finds all.

    Searches and entries meet on pieces of one to three characters: of the code's beginning, and of any place in the label. Only a search for nothing meets all entries.
    """
    q = asked.select("asked", F.lower(F.trim("asked")).alias("q")).distinct().withColumn("c", F.replace("q", F.lit(".")))
    bare, label = F.lower(F.replace("code", F.lit("."))), F.lower("label")
    words = F.filter(F.split("q", r"\s+"), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    piece = lambda kind, x: F.when(x != "", F.concat(F.lit(kind), F.substring(x, 1, 3)))
    keyed = q.select("*", F.explode(F.array_compact(F.array(piece("c", F.col("c")), piece("l", longest), F.when((F.col("c") == "") | (F.col("q") == ""), "all")))).alias("key"))
    begin = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.concat(F.lit("c"), F.substring(F.col("bare"), F.lit(1), n)))
    inside = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.concat(F.lit("l"), F.substring(F.col("low"), i, n)))))
    index = codes.select("code", "place", bare.alias("bare"), label.alias("low")).withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.lit("all")), begin, inside))))
    hit = F.col("bare").startswith(F.col("c")) | F.forall(words, lambda w: F.contains("low", w))
    met = keyed.join(index, "key").where(hit).select("asked", "code", "place").distinct()
    order = Window.partitionBy("asked").orderBy("place", "code")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("asked", "rank", "code")


@query("""WITH codes AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 5, '0')[1:2] || '.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0')[3:] AS code, p_name AS label, p_partkey AS place FROM part),
asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(string_split(p_name, ' ')[1]) WHEN 1 THEN 'p00.' || p_partkey % 10 WHEN 2 THEN string_split(p_name, ' ')[2] || '  ' || left(p_name, 4) ELSE 'P' END AS asked FROM part WHERE p_size < 6)
SELECT asked, row_number() OVER (PARTITION BY asked ORDER BY place, code) AS rank, code FROM asked, codes
WHERE starts_with(lower(replace(code, '.', '')), replace(lower(trim(asked)), '.', '')) OR len(list_filter(string_split_regex(lower(trim(asked)), '\\s+'), lambda w: w <> '' AND NOT contains(lower(label), w))) = 0 QUALIFY rank <= 8""")
def code_search(spark, sf_dir):
    """Parts stand for codes; what is asked are their names' words and beginnings of codes."""
    p = table(spark, sf_dir, "part")
    digits = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    codes = p.select(F.concat(F.lit("P"), F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3)).alias("code"), F.col("p_name").alias("label"), F.col("p_partkey").alias("place"))
    k, word = F.col("p_partkey") % 4, lambda i: F.get(F.split("p_name", " "), F.lit(i))
    asked = F.when(k == 0, F.concat(F.lit(" "), F.upper(word(0)))).when(k == 1, F.concat(F.lit("p00."), (F.col("p_partkey") % 10).cast("string"))).when(k == 2, F.concat(word(1), F.lit("  "), F.left("p_name", F.lit(4)))).otherwise("P")
    return search_codes(codes, p.where("p_size < 6").select(asked.alias("asked")))


# ---- where a source says what a claim says ----


def stem(word: Column) -> Column:
    """A crude stem: four common endings off what keeps four letters."""
    return F.when(F.length(word) >= 6, F.regexp_replace(word, "(?:ing|ed|es|s)$", "")).otherwise(word)


def _stems(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), stem)


def shortest_span(places: Column, wanted: Column) -> Column:
    """Struct (first, last) of the shortest run of places that holds every wanted stem; null if there is none; the first of equal ones. places: array of
    (place, stem) in order. One fold: the latest place of each stem so far is enough to know the shortest run that ends here."""
    state = F.struct(F.transform(wanted, lambda w: F.lit(None).cast("int")).alias("latest"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        latest = F.zip_with(wanted, acc["latest"], lambda w, at: F.when(w == p["stem"], p["place"]).otherwise(at))
        begin = F.when(~F.exists(latest, lambda x: x.isNull()), F.array_min(latest))
        better = begin.isNotNull() & (acc["first"].isNull() | (p["place"] - begin < acc["last"] - acc["first"]))
        return F.struct(latest.alias("latest"), F.when(better, begin).otherwise(acc["first"]).alias("first"), F.when(better, p["place"]).otherwise(acc["last"]).alias("last"))

    out = F.aggregate(places, state, step)
    return F.when(out["first"].isNotNull(), F.struct(out["first"].alias("first"), out["last"].alias("last")))


def anchors(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, claim, source, first, last): for claims (key, claim, text) the source sentences (key, source, text) of their key that hold all their stems, and the shortest span of words
    that does. They meet on the claim's rarest stem in its key; a claim without words has no anchor."""
    c = claims.select(key, "claim", F.array_distinct(_stems(F.col("text"))).alias("wanted")).where(F.size("wanted") > 0)
    s = sources.select(key, "source", _stems(F.col("text")).alias("words"))
    held = s.select(key, "source", F.explode(F.array_distinct("words")).alias("stem"))
    rare = held.groupBy(key, "stem").agg(F.count("*").alias("df"))
    probes = c.select(key, "claim", F.size("wanted").alias("n"), F.explode("wanted").alias("stem")).join(rare, [key, "stem"]).groupBy(key, "claim", "n").agg(F.min(F.struct("df", "stem")).alias("p"), F.count("*").alias("known"))
    # a stem that no source holds leaves the claim without an anchor
    met = probes.where("known = n").select(key, "claim", F.col("p.stem").alias("stem")).join(held, [key, "stem"]).select(key, "claim", "source")
    both = met.join(c, [key, "claim"]).join(s, [key, "source"]).where(F.size(F.array_except("wanted", "words")) == 0)
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("stem"))), lambda p: F.array_contains("wanted", p["stem"]))
    return both.select(key, "claim", "source", shortest_span(places, F.col("wanted")).alias("span")).select(key, "claim", "source", "span.first", "span.last")


_ST = "CASE WHEN length({w}) >= 6 THEN regexp_replace({w}, '(?:ing|ed|es|s)$', '') ELSE {w} END"


@query("WITH said AS (SELECT conv_id * 100 + turn AS doc_id, text FROM conversations), " + sentences_sql("said") + f""",
w AS (SELECT doc_id // 100 AS conv_id, doc_id % 100 * 1000 + n AS source, doc_id % 100 AS turn, n, list_transform(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+'), lambda x: {_ST.format(w="x")}) AS ws FROM sentences),
c AS (SELECT conv_id, source AS claim, list_distinct(ws[1:3]) AS wanted FROM w WHERE n = 0 AND len(ws) > 0), s AS (SELECT conv_id, source, ws FROM w),
m AS (SELECT c.conv_id, claim, source, wanted, ws FROM c JOIN s ON s.conv_id = c.conv_id AND len(list_filter(wanted, lambda x: NOT list_contains(ws, x))) = 0),
p AS (SELECT conv_id, claim, source, wanted, ws, unnest(range(len(ws))) AS a FROM m),
r AS (SELECT conv_id, claim, source, a, unnest(range(a, len(ws))) AS b, wanted, ws FROM p WHERE list_contains(wanted, ws[a + 1])),
k AS (SELECT conv_id, claim, source, a, b FROM r WHERE len(list_filter(wanted, lambda x: NOT list_contains(ws[a + 1:b + 1], x))) = 0)
SELECT conv_id, claim, source, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS last FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, claim, source ORDER BY b - a, b) = 1""")
def claim_anchors(spark, sf_dir):
    """Where a conversation's sentences hold the first three words of each of its turns."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    s = split_sentences(said, "conv_id", "turn").select("conv_id", (F.col("turn") * 1000 + F.col("n")).alias("source"), "n", F.col("sentence").alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    claims = s.where("n = 0").select("conv_id", F.col("source").alias("claim"), F.array_join(F.slice(words, 1, 3), " ").alias("text"))
    return anchors(claims, s.select("conv_id", "source", "text"), "conv_id")
