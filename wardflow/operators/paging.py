"""Pages both ways, prefix ranges, scopes of sites, canonical JSON, merge fields, stems, lines of CSV, and functions for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators.cleaning import csv_lines
from wardflow.operators.statements import MERGE_FIELD
from wardflow.registry import query
from wardflow.sources.tables import appointments, sql, table


def keyset_pages(rows: DataFrame, key: str, size: int, before=None, after=None) -> DataFrame:
    """A page of rows, newest (largest key) first, with has_older and has_newer. before: older than that key; after: the
    page just newer than it. The far side is asked with one row, not with a count."""
    backwards = before is None and after is not None
    side = rows if before is None and after is None else rows.where(F.col(key) < F.lit(before)) if before is not None else rows.where(F.col(key) > F.lit(after))
    some = side.orderBy(F.col(key).asc() if backwards else F.col(key).desc()).limit(size + 1)
    # the page is one row more than it shows at most, so its edges are found in what is already small
    edges = some.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))
    cut = edges.select("n", F.when(F.col("n") <= size, F.col("keys")).otherwise(F.slice("keys", F.lit(1), F.lit(size)) if backwards else F.slice("keys", F.lit(2), F.lit(size))).alias("keys"))
    beyond = rows.join(F.broadcast(cut.select(F.array_max("keys").alias("top"), F.array_min("keys").alias("low"))), F.lit(True))
    other = beyond.where(F.col(key) < F.col("low") if backwards else F.col(key) > F.col("top")).limit(1).agg((F.count("*") > 0).alias("other"))
    flags = cut.join(F.broadcast(other), F.lit(True)).select("keys", (F.col("other") if backwards else F.col("n") > size).alias("has_older"), (F.col("n") > size if backwards else F.col("other")).alias("has_newer"))
    return some.join(F.broadcast(flags), F.array_contains("keys", F.col(key))).drop("keys")


_PAGES = {"first": (None, None), "older": (400, None), "newer": (None, 400), "last": (6, None), "newest": (None, 995)}


def _page_sql(name: str, before, after, size: int = 7) -> str:
    backwards = before is None and after is not None
    test, order = ("true", "DESC") if before is None and after is None else (f"event_id < {before}", "DESC") if before is not None else (f"event_id > {after}", "ASC")
    return f"p_{name} AS MATERIALIZED (SELECT event_id FROM e WHERE {test} ORDER BY event_id {order} LIMIT {size}), b_{name} AS (SELECT min(event_id) AS low, max(event_id) AS top FROM p_{name})"


_SHOWN = " UNION ALL ".join(f"SELECT '{n}' AS page, event_id, (SELECT count(*) FROM e, b_{n} WHERE e.event_id < low) > 0 AS has_older, (SELECT count(*) FROM e, b_{n} WHERE e.event_id > top) > 0 AS has_newer FROM p_{n}" for n in _PAGES)


@query("WITH e AS (SELECT event_id FROM events),\n" + ",\n".join(_page_sql(n, *at) for n, at in _PAGES.items()) + "\n" + _SHOWN)
def audit_pages(spark, sf_dir):
    """Pages of seven entries of the log: the first, two older ones and two newer ones than given entries."""
    e, out = table(spark, sf_dir, "events").select("event_id"), None
    for name, (before, after) in _PAGES.items():
        page = keyset_pages(e, "event_id", 7, before, after).select(F.lit(name).alias("page"), "event_id", "has_older", "has_newer")
        out = page if out is None else out.unionByName(page)
    return out


def in_prefix(column: Column, prefix: str) -> Column:
    """Strings that start with a prefix of one character or more, as a half-open range that a scan can push down. The range ends before the
    prefix whose last character is the next one there is; behind the last of all characters nothing ends it."""
    short = prefix.rstrip("\U0010ffff")
    if not short:
        return column >= F.lit(prefix)
    last = 0xE000 if short[-1] == "\ud7ff" else ord(short[-1]) + 1
    return (column >= F.lit(prefix)) & (column < F.lit(short[:-1] + chr(last)))


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S') UNION ALL SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, (SELECT left(min(p_type), 4) FROM part))")
def prefix_range(spark, sf_dir):
    """Parts whose type starts with a letter, and with the first type's four."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    first = p.agg(F.min("p_type")).first()[0][:4]
    return p.where(in_prefix(F.col("p_type"), "S")).unionByName(p.where(in_prefix(F.col("p_type"), first)))


def sites_in_scope(allowed: list | None, chosen: list | None) -> list | None:
    """Sites that a viewer may see (None: all) and asks for (None: all of theirs); an empty list is no site."""
    return chosen if allowed is None else allowed if chosen is None else [s for s in chosen if s in allowed]


@query(sql("appts", "SELECT 'owner' AS viewer, count(*) AS n FROM appts WHERE site_id IN (1, 2) UNION ALL SELECT 'manager', count(*) FROM appts WHERE site_id = 2 UNION ALL SELECT 'desk', count(*) FROM appts WHERE site_id IN (0, 3) UNION ALL SELECT 'guest', 0"))
def scoped_counts(spark, sf_dir):
    """What four viewers count for the sites that they choose."""
    from wardflow.operators.relational import site_filter

    a, out = appointments(spark, sf_dir), None
    for viewer, allowed, chosen in (("owner", None, [1, 2]), ("manager", [2, 3], [1, 2]), ("desk", [0, 3], None), ("guest", [], [1])):
        n = a.where(site_filter("site_id", sites_in_scope(allowed, chosen))).agg(F.count("*").alias("n")).select(F.lit(viewer).alias("viewer"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct inside it in order of name, so that its JSON has one form."""
    if isinstance(kind, T.StructType):
        return F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def fingerprint(rows: DataFrame, *columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns, nulls included."""
    fields = F.struct(*[canonical(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


@query("""SELECT s_suppkey, sha256('{"list":[{"a":' || s_nationkey || ',"z":"x"},{"a":' || s_suppkey || ',"z":null}],"map":{"k1":1,"k2":' || s_nationkey || '},"who":{"id":' || s_suppkey || ',"name":"' || s_name || '"}}') AS fingerprint FROM supplier""")
def canonical_fingerprints(spark, sf_dir):
    """Nested records whose fields come in another order than their names have."""
    s = table(spark, sf_dir, "supplier")
    item = lambda z, a: F.struct(z.cast("string").alias("z"), F.col(a).cast("long").alias("a"))
    rows = s.select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")).alias("who"), F.create_map(F.lit("k2"), F.col("s_nationkey"), F.lit("k1"), F.lit(1)).alias("map"), F.array(item(F.lit("x"), "s_nationkey"), item(F.lit(None), "s_suppkey")).alias("list"))
    return rows.select("s_suppkey", fingerprint(rows, "who", "map", "list").alias("fingerprint"))


# ---- merge fields ----

_OPENERS = r"^(?:«|<<|\{\{|MERGEFIELD )\s*|\s*(?:»|>>|\}\})$"


def merge_names(text: Column) -> Column:
    """Names of the merge fields of a text, in order: «Name», <<Name>>, {{name}} or MERGEFIELD Name."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({MERGE_FIELD})"), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, _OPENERS, "")))


def fill_fields(text: Column, values: dict[str, Column]) -> Column:
    """The text with each field whose name is known replaced, however it is written; others stay."""
    for name, value in values.items():
        form = rf"(?i)(?:«\s*{name}\s*»|<<\s*{name}\s*>>|\{{\{{\s*{name}\s*\}}\}}|MERGEFIELD {name}\b)"
        text = F.regexp_replace(text, F.lit(form), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1"))
    return text


_LETTERS = ("Dear «Name», see <<Ref>>.", "{{ name }} owes {{pence}} to {{Clinic}}", "MERGEFIELD Name and «unknown»", "no field here", "<<NAME>> «Name»", None)


@query(f"""WITH t AS (SELECT s_suppkey, s_name, ([{", ".join("NULL" if x is None else f"'{x}'" for x in _LETTERS)}])[CAST(s_suppkey % {len(_LETTERS)} + 1 AS INTEGER)] AS t FROM supplier),
f AS (SELECT *, regexp_replace(regexp_replace(t, '(?i)«\\s*name\\s*»|<<\\s*name\\s*>>|\\{{\\{{\\s*name\\s*\\}}\\}}|MERGEFIELD name\\b', s_name, 'g'), '(?i)«\\s*ref\\s*»|<<\\s*ref\\s*>>|\\{{\\{{\\s*ref\\s*\\}}\\}}|MERGEFIELD ref\\b', 'R' || s_suppkey, 'g') AS filled FROM t)
SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(t, '{MERGE_FIELD}'), lambda x: lower(regexp_replace(x, '{_OPENERS}', '', 'g'))), ',') AS names, filled, len(regexp_extract_all(filled, '{MERGE_FIELD}')) AS unfilled FROM f""")
def merge_tokens(spark, sf_dir):
    """Fields of letters in every spelling: their names, the filled letter, and how many stay open."""
    letter = F.element_at(F.array(*map(F.lit, _LETTERS)), (F.col("s_suppkey") % len(_LETTERS) + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumn("t", letter)
    filled = fill_fields(F.col("t"), {"name": F.col("s_name"), "ref": F.concat(F.lit("R"), F.col("s_suppkey"))})
    return s.select("s_suppkey", F.array_join(merge_names(F.col("t")), ",").alias("names"), filled.alias("filled")).withColumn("unfilled", F.regexp_count("filled", F.lit(MERGE_FIELD)).cast("long"))


# ---- stems ----


def stem(word: Column) -> Column:
    """A word without a common ending, if three letters stay."""
    return F.regexp_replace(word, r"^(.{3,}?)(?:ning|ned|ing|ed|es|s)$", "$1")


@query(r"""WITH w AS (SELECT conv_id, turn, role, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3), lambda x: regexp_replace(x, '^(.{3,}?)(?:ning|ned|ing|ed|es|s)$', '\1')))) AS stem FROM conversations),
n AS (SELECT conv_id, turn, count(*) AS stems FROM w WHERE role = 'assistant' GROUP BY 1, 2),
m AS (SELECT a.conv_id, a.turn, b.turn AS source_turn, count(*) AS shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.stem = b.stem AND b.role = 'user' WHERE a.role = 'assistant' GROUP BY 1, 2, 3)
SELECT conv_id, turn, max(shared) AS shared, min(source_turn) FILTER (shared = top) AS source_turn, max(shared) / any_value(stems) AS share FROM (SELECT *, max(shared) OVER (PARTITION BY conv_id, turn) AS top FROM m JOIN n USING (conv_id, turn)) GROUP BY 1, 2""")
def stem_share(spark, sf_dir):
    """For each answer, the turn of its conversation that holds the largest share of its stems."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 3)
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.transform(words, stem))).alias("stem"))
    said, asked = w.where("role = 'assistant'").drop("role"), w.where("role = 'user'").select("conv_id", F.col("turn").alias("source_turn"), "stem")
    stems = said.groupBy("conv_id", "turn").agg(F.count("*").alias("stems"))
    m = said.join(asked, ["conv_id", "stem"]).groupBy("conv_id", "turn", "source_turn").agg(F.count("*").alias("shared"))
    best = m.groupBy("conv_id", "turn").agg(F.max(F.struct("shared", (-F.col("source_turn")).alias("t"))).alias("b")).join(stems, ["conv_id", "turn"])
    return best.select("conv_id", "turn", "b.shared", (-F.col("b.t")).alias("source_turn"), (F.col("b.shared") / F.col("stems")).alias("share"))


# ---- exports ----


@query("""SELECT s_suppkey, s_suppkey || ',"' || replace('Site ' || s_name || ', "main"', '"', '""') || '",' || CASE WHEN s_acctbal < 0 THEN chr(39) || CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) ELSE CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END || ',' || CASE WHEN s_nationkey % 3 = 0 THEN '' WHEN s_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END || ',' || CASE s_suppkey % 3 WHEN 0 THEN '''=1+1' WHEN 1 THEN 'plain' ELSE '''@x' END AS line FROM supplier""")
def report_lines(spark, sf_dir):
    """Lines of an exported report: quoting, formulas made harmless, yes and no, nothing for null."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    note = F.element_at(F.array(F.lit("=1+1"), F.lit("plain"), F.lit("@x")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    columns = {"id": F.col("s_suppkey"), "name": F.concat(F.lit("Site "), "s_name", F.lit(', "main"')), "balance": F.col("s_acctbal").cast("decimal(12,2)"), "active": F.when(n % 3 != 0, n % 2 == 0), "note": note}
    return csv_lines(s, columns).select("s_suppkey", "line")


# ---- functions for SQL ----

#: Functions that SQL text can call: declared in SQL, so that the optimiser sees through them.
SQL_FUNCTIONS = {
    "ward_pounds": "(pence BIGINT) RETURNS STRING RETURN concat(CASE WHEN pence < 0 THEN '-' ELSE '' END, '£', format_number(abs(pence) / 100, 2))",
    "ward_share": "(part BIGINT, whole BIGINT) RETURNS DOUBLE RETURN CASE WHEN whole > 0 THEN part / whole END",
    "ward_debt_band": "(days INT) RETURNS STRING RETURN CASE WHEN days <= 0 THEN 'not due' WHEN days <= 30 THEN '1-30' WHEN days <= 60 THEN '31-60' WHEN days <= 90 THEN '61-90' ELSE 'over 90' END",
    "ward_age": "(born DATE, at DATE) RETURNS INT RETURN CAST(floor(months_between(at, born) / 12) AS INT)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Declares the functions in the session and returns their names. A table function lists the figures of a text."""
    from pyspark.sql.functions import udtf

    from wardflow.operators.figures import figures_of

    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    class Figures:
        def eval(self, text: str):
            for kind, figure, raw, start in figures_of(text or ""):
                yield kind, figure, raw, start

    spark.udtf.register("ward_figures", udtf(Figures, returnType="kind string, figure string, raw string, start int"))
    return [*SQL_FUNCTIONS, "ward_figures"]


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN '-' ELSE '' END || '£' || format('{:,.2f}', abs(CAST(round(o_totalprice * 100) AS BIGINT)) / 100) AS pounds, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 5) / (o_orderkey % 3) END AS share,
CASE WHEN d <= 0 THEN 'not due' WHEN d <= 30 THEN '1-30' WHEN d <= 60 THEN '31-60' WHEN d <= 90 THEN '61-90' ELSE 'over 90' END AS band FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS d FROM orders)""")
def sql_functions(spark, sf_dir):
    """Declared functions called from SQL text."""
    register_functions(spark)
    o = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, ward_pounds(CAST(round(o_totalprice * 100) AS BIGINT)) AS pounds, ward_share(o_custkey % 5, o_orderkey % 3) AS share, ward_debt_band(datediff(DATE'2001-08-01', CAST(o_orderdate AS DATE))) AS band FROM {o}", o=o)


@query("SELECT p_partkey, 'duration' AS kind, p_size || ':week' AS figure, 4 AS start FROM part UNION ALL SELECT p_partkey, 'number', CAST(p_partkey AS VARCHAR), 15 + length(CAST(p_size AS VARCHAR)) FROM part WHERE NOT regexp_matches(CAST(p_partkey AS VARCHAR), '^(19|20)[0-9]{2}$') UNION ALL SELECT p_partkey, 'year', CAST(p_partkey AS VARCHAR), 15 + length(CAST(p_size AS VARCHAR)) FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '^(19|20)[0-9]{2}$')")
def sql_table_function(spark, sf_dir):
    """Figures of a text by a table function, with their places. A small file is one task of the scan, so rows are spread before the function reads them."""
    register_functions(spark)
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("for %d weeks, no %d", F.col("p_size").cast("long"), F.col("p_partkey")).alias("t")).repartition("p_partkey")
    return spark.sql("SELECT p_partkey, f.kind, f.figure, f.start FROM {p} p, LATERAL ward_figures(p.t) f", p=p)
