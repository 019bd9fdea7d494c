"""Conversation structure repair: the cheapest edits that bring a conversation's roles to `(s?(ua)+)?`.

A DuckDB recursive query runs inside hash-partitioned batches. Its items are segments, runs of at most SEGMENT rows of
one conversation; each recursion advances every segment of the batch by one turn and keeps, for each grammar state, the
least cost and the audit that reaches it. A segment that doesn't begin its conversation is solved from each of the four
states, and the same recursion then strings FAN segments together until one is left, so that a conversation of any
length is spread over tasks. Where costs tie, the audit that is least in ASCII wins; two audits of equal cost that reach one state
after the same rows are never prefixes of each other (what is longer has inserted more), so the least ones may be extended.
One insertion between rows is enough: two return to the same state, or leave the state after `s`, whose row is cheaper deleted.

Rows are put in order by range partitions on (conversation, turn, role, text), not by one window for each conversation.
Repeats are found by grouping digests of (role, text), which combines before it shuffles.

Defined cases: null roles and texts count as one blank; null turns come first; rows of one turn follow each other by role
and then text; a null conv_id is a conversation of its own; a role with no first character can't be kept; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm._util import Workspace

SEGMENT = 512
FAN = 32
#: Rows of conversations in one run of the recursive query; a run holds four audits of up to SEGMENT letters for each of four beginnings.
BATCH_ROWS = 40_000
#: Letters of the audits that are strung together in one run, at most, or one group's.
BATCH_AUDITS = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The states: nothing yet, after s, after u, after a. What each accepts next.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ALTERNATES = {2: "a"}
_BLANKS = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the row is dropped), by the crc32 of `conv_id:turn` modulo 20."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", field("conv_id"), field("turn"))) % 20
    text = field("text")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(field("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _moves() -> pa.Table:
    """(state, code, target, cost, edits): what one row allows. Codes: s u a x by role, in capitals if truncated, d if it has to go."""
    out = []
    for state in range(4):
        for inserted in (0, 1):
            at = _NEXT[state][_ALTERNATES.get(state, "u")] if inserted else state
            lead, base = "I" * inserted, INSERT * inserted
            for code in "suaxSUAXd":
                out.append((state, code, at, base + DELETE, lead + "D"))
                if code != "d":
                    fault = TRUNCATED * code.isupper()
                    if code.lower() in _NEXT[at]:
                        out.append((state, code, _NEXT[at][code.lower()], base + KEEP + fault, lead + "K"))
                    out.append((state, code, _NEXT[at][_ALTERNATES.get(at, "u")], base + REROLE + fault, lead + "R"))
    return pa.table(dict(zip(("state", "code", "target", "cost", "edits"), zip(*out, strict=True), strict=True)))


_PATHS = """
WITH RECURSIVE best(item, origin, state, step, path) USING KEY (item, origin, state) AS (
    SELECT i.item, o.origin, o.origin, 0, {{'cost': 0::BIGINT, 'audit': ''}}
    FROM items i JOIN (SELECT unnest([0, 1, 2, 3]) AS origin) o ON o.origin = 0 OR NOT i.opens
  UNION
    SELECT b.item, b.origin, m.target, b.step + 1, min({{'cost': b.path.cost + m.cost, 'audit': b.path.audit || m.edits}})
    FROM best b JOIN items i ON i.item = b.item JOIN moves m ON {how}
    WHERE b.step < i.n
    GROUP BY b.item, b.origin, m.target, b.step
)
SELECT b.item, list({{'origin': b.origin, 'state': b.state, 'cost': b.path.cost, 'audit': b.path.audit}}) AS paths
FROM best b JOIN items i ON i.item = b.item AND b.step = i.n GROUP BY b.item
"""
#: Rows of a segment, by their codes; and segments one after the other, by their own paths.
_OVER_ROWS = _PATHS.format(how="m.state = b.state AND m.code = i.codes[b.step + 1]")
_OVER_SEGMENTS = _PATHS.format(how="m.item = b.item AND m.step = b.step AND m.state = b.state")
_PATH_TYPE = "array<struct<origin: int, state: int, cost: bigint, audit: string>>"


def _solve(items: pa.Table, moves: pa.Table, sql: str) -> dict[int, list[dict]]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as con:
        con.register("given_items", items)
        con.register("given_moves", moves)
        con.execute("CREATE TABLE items AS FROM given_items")
        con.execute("CREATE TABLE moves AS FROM given_moves")
        return dict(con.execute(sql).fetchall())


def _segment_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moves = _moves()
    for batch in batches:
        sizes, begin, held = batch.column("n").to_pylist(), 0, 0
        for i, n in enumerate([*sizes, BATCH_ROWS]):
            if i > begin and (held + n > BATCH_ROWS or i == len(sizes)):
                part = batch.slice(begin, i - begin)
                opens = pa.array([k == 1 for k in part.column("k").to_pylist()])
                found = _solve(pa.table({"item": pa.array(range(len(part)), pa.int64()), "opens": opens, "n": part.column("n"), "codes": part.column("codes")}), moves, _OVER_ROWS)
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("k"), pa.array([found[j] for j in range(len(part))], _ARROW_PATHS)], ["conv", "k", "paths"])
                begin, held = i, 0
            held += n


_ARROW_PATHS = pa.list_(pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _chained_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved(rows: list[dict]) -> pa.RecordBatch:
        steps = [(item, step, p["origin"], p["state"], p["cost"], p["audit"]) for item, row in enumerate(rows) for step, part in enumerate(row["parts"]) for p in part["paths"]]
        moves = pa.table(dict(zip(("item", "step", "state", "target", "cost", "edits"), zip(*steps, strict=True), strict=True)))
        items = pa.table({"item": pa.array(range(len(rows)), pa.int64()), "opens": [row["k"] == 1 for row in rows], "n": pa.array([len(row["parts"]) for row in rows], pa.int64())})
        found = _solve(items, moves, _OVER_SEGMENTS)
        return pa.RecordBatch.from_arrays([pa.array([row["conv"] for row in rows]), pa.array([row["k"] for row in rows], pa.int32()), pa.array([found[j] for j in range(len(rows))], _ARROW_PATHS)], ["conv", "k", "paths"])

    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            held.append(row)
            size += sum(len(p["audit"]) for part in row["parts"] for p in part["paths"])
            if size > BATCH_AUDITS:
                yield solved(held)
                held, size = [], 0
    if held:
        yield solved(held)


def _in_order(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and pos, which ascends by conversation, turn, role and text and counts up by one inside a partition."""
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    plain = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), copies.alias("copies")).where("copies > 0")
    dealt = plain.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))


def _faults(ordered: DataFrame) -> DataFrame:
    """conv, pos, initial (s u a x) and fault (b d t, or a point) of each row."""
    ends = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    initial = F.left("role", F.lit(1))
    own = ordered.select("conv", "pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), ends.alias("ends"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"))
    again = own.where("ends != ''").groupBy("conv", "h1", "h2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    fault = F.when(F.col("ends") == "", "b").when(F.col("first") < F.col("pos"), "d").when(~F.col("ends").isin(".", "!", "?"), "t").otherwise(".")
    return own.join(again, ["conv", "h1", "h2"], "left").select("conv", "pos", "initial", fault.alias("fault"))


def _segments(faults: DataFrame, segment: int) -> DataFrame:
    """One row for each segment: conv, k (from 1), first_pos, n, before (rows of the conversation before it), codes and counts."""
    rows = faults.groupBy("conv", F.floor(F.col("pos") / segment).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "fault"))).alias("r"))
    code = lambda x: F.when(x["fault"].isin("b", "d"), "d").when(x["fault"] == "t", F.upper(x["initial"])).otherwise(x["initial"])
    count = lambda c: F.size(F.filter("r", lambda x: x["fault"] == c)).cast("long")
    flat = rows.select("conv", F.col("r")[0]["pos"].alias("first_pos"), F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", code), "").alias("codes"), F.array_join(F.transform("r", lambda x: x["initial"]), "").alias("initials"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    order = Window.partitionBy("conv").orderBy("first_pos")
    joined = F.concat(F.coalesce(F.right(F.lag("initials").over(order), F.lit(1)), F.lit("")), F.col("initials"))
    numbered = flat.select("*", F.row_number().over(order).alias("k"), (F.sum("n").over(order) - F.col("n")).alias("before"), joined.alias("seen"))
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.length("seen") - 1, F.lit(1))), lambda i: (i < F.length("seen")) & ~F.substr("seen", i, F.lit(2)).isin("su", "ua", "au"))
    return numbered.withColumn("illegal", F.size(pairs).cast("long")).drop("initials", "seen")


def plan_edits(rows: DataFrame, space: Workspace, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows in order, one row for each conversation with counts, cost and audit, the edits of each segment)."""
    ordered = space.save(_in_order(rows), "ordered")
    segments = space.save(_segments(_faults(ordered), segment), "segments")
    level = space.save(segments.select("conv", "k", "n", "codes").repartition("conv", "k").mapInArrow(_segment_paths, f"conv string, k int, paths {_PATH_TYPE}"), "paths")
    longest = level.agg(F.max("k")).first()[0] or 1
    while longest > 1:
        grouped = level.groupBy("conv", F.floor((F.col("k") - 1) / fan).cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "paths"))).alias("parts"))
        alone, several = grouped.where(F.size("parts") == 1), grouped.where(F.size("parts") > 1)
        chained = several.select("conv", (F.col("g") + 1).alias("k"), "parts").mapInArrow(_chained_paths, f"conv string, k int, paths {_PATH_TYPE}")
        level = space.save(alone.select("conv", (F.col("g") + 1).cast("int").alias("k"), F.col("parts")[0]["paths"].alias("paths")).unionByName(chained), "paths")
        longest = -(-longest // fan)
    closed = F.transform(F.filter("paths", lambda p: (p["origin"] == 0) & (p["state"] != 1)), lambda p: F.struct((p["cost"] + F.when(p["state"] == 2, INSERT).otherwise(0)).alias("cost"), F.concat(p["audit"], F.when(p["state"] == 2, "I").otherwise("")).alias("audit")))
    best = level.select("conv", F.array_min(closed).alias("best")).select("conv", "best.cost", "best.audit")
    counted = segments.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.struct("first_pos", "n", "before"))).alias("parts"))
    whole = space.save(counted.join(best, "conv"), "edits")
    # one entry for each row: what is inserted before it and its own edit; what is inserted last goes with the last segment
    edits = F.regexp_extract_all("audit", F.lit("(I*[KRD])"), F.lit(1))
    tail = F.regexp_extract("audit", "(I*)$", 1)
    cut = lambda p: F.struct(p["first_pos"].alias("pos"), F.array_join(F.slice(F.col("rows"), (p["before"] + 1).cast("int"), p["n"].cast("int")), "").alias("edits"), (p["before"] + p["n"] == F.size("rows")).alias("last"))
    slices = whole.select("conv", "parts", edits.alias("rows"), tail.alias("tail")).select("conv", "tail", F.explode(F.transform("parts", cut)).alias("s"))
    return ordered, whole.drop("parts"), slices.select("conv", "s.pos", F.concat("s.edits", F.when(F.col("s.last"), F.col("tail")).otherwise("")).alias("edits"))


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """(conv, role, text) of what the edits leave, in order; (conv, None, None) where a conversation begins. Reads a stream of slices and rows."""
    conv, edits, ending, rest, following = None, iter(()), "", 0, "user"
    for batch in batches:
        for at, kind, role, text, given in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "edits")), strict=True):
            if at != conv:
                conv, following = at, "user"
                yield conv, None, None
            if kind == 0:  # a slice: what it inserts last, after its rows, can only be the end of the conversation
                body = given.rstrip("I")
                edits = iter(body)
                ending = given[len(body) :]
                rest = sum(x != "I" for x in body)
                continue
            for edit in edits:
                if edit in "IR":
                    yield conv, following, "" if edit == "I" else text
                    following = "assistant" if following == "user" else "user"
                elif edit == "K":
                    yield conv, role, text
                    following = "assistant" if role[0] == "u" else "user"
                if edit != "I":
                    rest -= 1
                    break
            if not rest:
                for _ in ending:
                    yield conv, following, ""
                    following = "assistant" if following == "user" else "user"
                ending = ""


def _stream(ordered: DataFrame, slices: DataFrame) -> DataFrame:
    """Slices and rows of each conversation in one partition and in order, a slice before its rows."""
    none = F.lit(None).cast("string")
    both = slices.select("conv", "pos", F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), "edits").unionByName(ordered.select("conv", "pos", F.lit(1).alias("kind"), "role", "text", none.alias("edits")))
    return both.repartition("conv").sortWithinPartitions("conv", "pos", "kind")


def repaired_rows(rows: DataFrame, space: Workspace, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """conv_id (as text), place (from 0), role, text: the repaired conversations."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for conv, role, text in _played(batches):
            place = 0 if role is None else place
            if role is not None:
                held.append((conv[1:] if conv[0] == "v" else None, place, role, text))
                place += 1
            if len(held) >= 4096:
                yield _rows_batch(held)
                held = []
        if held:
            yield _rows_batch(held)

    ordered, _, slices = plan_edits(rows, space, segment, fan)
    return _stream(ordered, slices).mapInArrow(play, "conv_id string, place long, role string, text string")


def _rows_batch(held: list) -> pa.RecordBatch:
    conv, place, role, text = zip(*held, strict=True)
    return pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.string()), "place": pa.array(place, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, sha256 of its `role:text` lines joined by \\n."""
    done, conv, digest, began = [], None, None, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": pa.array([x[0] for x in done], pa.string()), "repaired_sha256": pa.array([x[1] for x in done], pa.string())})

    for at, role, text in _played(batches):
        if role is None:
            if conv is not None:
                done.append((conv, digest.hexdigest()))
            conv, digest, began = at, hashlib.sha256(), False
        else:
            digest.update(f"{chr(10) if began else ''}{role}:{text}".encode())
            began = True
        if len(done) >= 4096:
            yield out()
            done = []
    if conv is not None:
        done.append((conv, digest.hexdigest()))
    yield out()


def repair(rows: DataFrame, space: Workspace, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """For each conversation of the rows, those whose rows all have 0 copies too: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered, whole, slices = plan_edits(rows, space, segment, fan)
    shas = _stream(ordered, slices).mapInArrow(_digests, "conv string, repaired_sha256 string")
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("conv")
    turn = F.col("turn") if "copies" not in rows.columns else F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    every = rows.select("conv_id", conv, turn.cast("long").alias("turn")).groupBy("conv", "conv_id").agg(gaps.alias("gaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(whole.join(shas, "conv"), "conv", "left").select("conv_id", "gaps", *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The whole query in SQL: crc32 bit by bit, and one recursion over whole conversations, which carries the repaired text with the audit.
ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::UBIGINT) ELSE z >> 1 END)), 4294967295::UBIGINT) % 20 AS kind FROM keyed),
damaged AS (SELECT coalesce('v' || conv_id, 'n') AS conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, E' \t\n\x0B\f\r') AS bare FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS before FROM placed),
best AS (
  SELECT conv, 0 AS state, 0::BIGINT AS k, {'cost': 0, 'audit': '', 'text': NULL::VARCHAR} AS path FROM judged GROUP BY conv
  UNION ALL
  SELECT conv, target, k, min({'cost': cost, 'audit': audit, 'text': text}) FROM (
    SELECT b.conv, f.k, CASE edit WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE WHEN initial = 'u' AND mid <> 2 THEN 2 WHEN initial = 'a' AND mid = 2 THEN 3 WHEN initial = 's' AND mid = 0 THEN 1 END END AS target,
      b.path.cost + 5 * ins + CASE edit WHEN 'D' THEN 2 ELSE CASE edit WHEN 'R' THEN 1 ELSE 0 END + CASE fault WHEN 't' THEN 5 ELSE 0 END END AS cost, b.path.audit || CASE ins WHEN 1 THEN 'I' ELSE '' END || edit AS audit,
      nullif(concat_ws(chr(10), b.path.text, CASE WHEN ins = 1 THEN CASE b.state WHEN 2 THEN 'assistant:' ELSE 'user:' END END, CASE edit WHEN 'K' THEN f.role || ':' || f.text WHEN 'R' THEN CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text END), '') AS text
    FROM (SELECT *, CASE WHEN ins = 1 THEN CASE state WHEN 2 THEN 3 ELSE 2 END ELSE state END AS mid FROM best, (VALUES (0), (1)) i(ins)) b JOIN judged f ON f.conv = b.conv AND f.k = b.k + 1, (VALUES ('K'), ('R'), ('D')) e(edit) WHERE edit = 'D' OR fault NOT IN ('b', 'd')
  ) WHERE target IS NOT NULL GROUP BY conv, target, k),
ended AS (SELECT conv, min({'cost': path.cost + CASE state WHEN 2 THEN 5 ELSE 0 END, 'audit': path.audit || CASE state WHEN 2 THEN 'I' ELSE '' END, 'text': nullif(concat_ws(chr(10), path.text, CASE state WHEN 2 THEN 'assistant:' END), '')}) AS path
  FROM best JOIN (SELECT conv, max(k) AS k FROM judged GROUP BY conv) USING (conv, k) WHERE state <> 1 GROUP BY conv),
counted AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(path.cost, 0)::BIGINT AS cost, coalesce(path.audit, '') AS audit, sha256(coalesce(path.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted d ON d.conv = coalesce('v' || c.conv_id, 'n') LEFT JOIN ended e ON e.conv = d.conv
"""
