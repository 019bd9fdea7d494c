"""Line dedup by site-relative frequency.

Pages are cut into lines at block tags and line breaks; for each host, the pages holding a line are divided by the
host's pages, and lines above the boilerplate ratio are dropped.

Defined cases: null html has no lines; a page without a readable url belongs to host "" ; a line found on fewer than
`min_pages` pages of a host is never boilerplate, so a host with fewer pages than that loses nothing; repeated page rows count as
pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace, narrow

RATIO = 0.3
MIN_PAGES = 3
#: Pages of a host that are kept together; a host with more is spread over as many parts as that takes.
HOST_PART = 200
#: Tags inside a line; every other tag ends one.
INLINE = r"(?i)</?(?:a|b|i|u|s|em|strong|span|small|sub|sup|mark|code|abbr|cite|q|font)(?:\s[^<>]*)?>"
BREAK = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^<>]*>|[\r\n]"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_lines(html: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(html, F.lit("")), INLINE, ""), BREAK), lambda x: F.trim(x)), lambda x: x != "")


def line_key(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def drop_boilerplate(pages: DataFrame, space: Workspace, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_dropped, text (kept lines).

    The boilerplate set of a host holds at most (mean distinct lines per page) / ratio keys, so the array joined to
    its pages stays small however many pages the host has.
    """
    cut = space.save(pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines")), "lines")
    parts = F.ceil(F.col("host_pages") / HOST_PART)
    totals = space.save(cut.groupBy("host").agg(F.count("*").alias("host_pages")).withColumn("parts", parts), "totals")
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    large = narrow(totals.where("parts > 1").select("host", "parts"))
    salted = lambda rows, key: rows.join(large, "host", "left").withColumn("salt", F.pmod(key, F.coalesce("parts", F.lit(1))).cast("long")).drop("parts")
    seen = cut.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key")).groupBy("host", "key").agg(F.count("*").alias("with_line")).where(F.col("with_line") >= min_pages)
    # a host may hold a third of all pages: its rows are spread over its parts, and the host's own row goes to each
    often = salted(seen, F.col("key")).join(spread.drop("parts"), ["host", "salt"]).where(F.col("with_line") > F.col("host_pages") * ratio).groupBy("host").agg(F.collect_list("key").alias("drop"))
    per_host = spread.drop("parts").join(often, "host", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    kept = F.when(F.size("drop") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), line_key(x))))
    return (
        salted(cut, F.xxhash64("page_id", "lines"))
        .join(per_host, ["host", "salt"])
        .withColumn("kept", kept)
        .select("page_id", "host", "host_pages", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    )


ORACLE = rf"""
WITH cut AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '{INLINE}', '', 'g'), '{BREAK}'), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM cut GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) JOIN totals USING (host)
  GROUP BY host, line, host_pages HAVING count(*) >= {MIN_PAGES} AND count(*) > host_pages * {RATIO}::DOUBLE),
sets AS (SELECT host, list(line) AS bad FROM often GROUP BY host),
kept AS (
  SELECT page_id, cut.host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM cut JOIN totals USING (host) LEFT JOIN sets ON sets.host = cut.host)
SELECT page_id, host, host_pages, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM kept
"""
