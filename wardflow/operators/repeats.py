"""Sentences that say again what an earlier one of their text says.

Two sentences repeat if the smaller one's content words are in the other to a share, the figures of one other than dates are all among the
other's, dates and times that both give have one in common, neither denies what the other asserts, and words of contrast of one kind don't clash.
What a sentence states is worked out once, as columns, and saved; sentences with equal facts are one class, known by a digest, so a line repeated a thousand
times is one row. Classes of one key meet with a bitmap of their words each, and only pairs whose bitmaps allow it are compared; in a key of very many sentences they meet on the
groups of their words.

Defined cases: null sentences state nothing and repeat nothing; sentences of less than five words or three content words are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.sentence_spans import sentences_sql, split_sentences
from wardflow.registry import query
from wardflow.sources.tables import table

# Words without content, words of contrast by kind, words of time and the point they stand for, negations and what they look past.
STOP = "a an the and or but of to in on at for with by from as is are was were be been has have had it its this that these those he she they we you i not no".split()
CONTRAST = {
    "side": "left right bilateral bilaterally unilateral".split(),
    "severity": "mild mildly moderate moderately severe severely slight slightly marked markedly significant significantly minimal minor major extreme".split(),
    "pattern": "constant constantly intermittent intermittently occasional occasionally persistent persistently frequent frequently rare rarely sometimes always episodic regular regularly".split(),
    "direction": "better worse improved improving improvement worsened worsening deteriorated deteriorating unchanged increased increasing decreased decreasing reduced reducing resolved resolving settled settling eased easing".split(),
    "count": "one two three four five six seven eight nine ten eleven twelve once twice thrice half quarter".split(),
    "result": "positive negative normal abnormal full partial partially limited restricted".split(),
}
TIMES = {"first": "first", "initial": "initial", "initially": "initial", "baseline": "initial", "outset": "initial", "onset": "onset", "presentation": "presentation", "presenting": "presentation", "admission": "admission", "referral": "referral", "pre": "pre", "preinjury": "pre", "earlier": "previous", "discharge": "discharge", "discharged": "discharge", "now": "now", "current": "now", "currently": "now", "today": "now", "presently": "now", "latest": "latest", "final": "final", "finally": "final", "still": "still"}
#: Times that place a sentence loosely are no point of their own.
LOOSE = ("previous",)
NEGATIONS = "no not nil none never nothing neither nor without denies denied deny absent unremarkable unable cannot can't isn't wasn't weren't aren't doesn't didn't don't hasn't haven't hadn't won't couldn't wouldn't shouldn't".split()
FILLER = "longer yet really very fully quite".split()

_WORD = r"[\p{L}]+(?:['’][\p{L}]+)?"
_CLAUSE = r"[,;:()–—]|\s-\s|\band\b|\bbut\b"
_FREE = r"\b([\p{L}]+)[- ]free\b"
_SIDE = r"(?:^|[^0-9A-Za-z_])(LHS|RHS|Lt|Rt|L|R)(?:$|[^0-9A-Za-z_/])"
_FIGURE = r"[0-9]+(?:[./,:-][0-9]+)*"
_DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
_MARK_OF = {w: f"{kind}:{w}" for kind, words in CONTRAST.items() for w in words}
_TIME_OF = {w: t for w, t in TIMES.items() if t not in LOOSE}


def _in(x: Column, words) -> Column:
    return x.isin(*words)


def sentence_facts(rows: DataFrame) -> DataFrame:
    """Adds to rows with `sentence` what it states: content (distinct content words), figures (sorted, repeats kept), times (dates and words of time), negated (words that a
    negation reaches: the next two content words of its clause), denied (those that it doesn't assert elsewhere) and marks (words of contrast with their kind)."""
    words = lambda text: F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    content = lambda w: (F.length(w) > 1) & ~_in(w, STOP)
    set_ = lambda a: F.array_sort(F.array_distinct(a))
    named = lambda table_: F.create_map(*[F.lit(x) for pair in table_.items() for x in pair])
    figures = F.regexp_extract_all("sentence", F.lit(f"({_FIGURE})"), F.lit(1))
    sides = F.transform(F.regexp_extract_all(F.replace("sentence", F.lit(" "), F.lit("  ")), F.lit(_SIDE), F.lit(1)), lambda s: F.when(s.startswith("L"), "side:left").otherwise("side:right"))
    plain = F.regexp_replace(F.lower("sentence"), _FREE, "no $1")

    def reached(tokens: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.coalesce(_in(F.replace(F.get(tokens, i), F.lit("’"), F.lit("'")), NEGATIONS), F.lit(False)))
        behind = lambda i: F.filter(F.slice(tokens, i + 2, F.size(tokens)), lambda w: content(w) & ~_in(w, FILLER))
        return F.flatten(F.transform(at, lambda i: F.slice(behind(i), 1, 2)))

    out = rows.withColumn("w", words(F.lower("sentence"))).where(F.size("w") >= 5).withColumn("content", set_(F.filter("w", content))).where(F.size("content") >= 3)
    out = out.withColumn("p", F.transform(F.split(plain, _CLAUSE), words)).withColumn("r", F.flatten(F.transform("p", reached))).withColumn("p", F.flatten("p"))
    return out.withColumns(
        {
            "figures": F.array_sort(F.filter(figures, lambda f: ~f.rlike(_DATE))),
            "times": set_(F.concat(F.filter(figures, lambda f: f.rlike(_DATE)), F.array_compact(F.transform("w", lambda w: F.element_at(named(_TIME_OF), w))))),
            "negated": set_(F.col("r")),
            "denied": F.filter(set_(F.col("r")), lambda w: F.size(F.filter("p", lambda x: x == w)) <= F.size(F.filter("r", lambda x: x == w))),
            "marks": set_(F.concat(F.array_compact(F.transform("w", lambda w: F.element_at(named(_MARK_OF), w))), sides)),
        }
    ).drop("w", "r", "p")


FACTS = ("content", "figures", "times", "negated", "denied", "marks")
#: Rows up to which a table of keys is broadcast, when counted.
FEW = 500_000


def multiset_within(a: Column, b: Column) -> Column:
    """Whether every item of array a is in array b at least as often."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.forall(F.array_distinct(a), lambda x: times(a, x) <= times(b, x))


def _of_kind(marks: Column, kind: str) -> Column:
    return F.filter(marks, lambda m: m.startswith(f"{kind}:"))


def same_finding(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the facts of two sentences, their words aside, can be of one finding."""
    clash = lambda x, y: F.size(F.array_except(F.array_intersect(x["denied"], y["content"]), y["negated"])) > 0
    out = ~clash(a, b) & ~clash(b, a) & (multiset_within(a["figures"], b["figures"]) | multiset_within(b["figures"], a["figures"]))
    out = out & ((F.size(a["times"]) == 0) | (F.size(b["times"]) == 0) | F.arrays_overlap(a["times"], b["times"]))
    for kind in CONTRAST:
        x, y = (_of_kind(f["marks"], kind) for f in (a, b))
        out = out & ((F.size(x) == 0) | (F.size(y) == 0) | (F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y))))
    return out


#: Sentences of a key up to which they meet each other at once; those of a longer key meet in groups of words, one group for each GROUP sentences.
WHOLE = 1500
GROUP = 100


def _signature(half: int) -> Column:
    """One of the two halves of a bitmap that has a bit for each content word."""
    return F.expr(f"aggregate(content, 0L, (a, x) -> a | if((xxhash64(x) >> 6) & 1 = {half}, shiftleft(1L, cast(xxhash64(x) & 63 AS INT)), 0L))")


def _candidates(classes: DataFrame, key: str, share: float, whole: int) -> DataFrame:
    """(key, a, b): classes of which the smaller one, a, may have its words in b. A word that b lacks accounts for each bit that b's bitmap lacks, so no pair is lost, and unlike
    pairs are dropped where they meet."""
    narrow = classes.select(key, "first", "size", "s0", "s1")
    sides = lambda x, y, *on: x.toDF(*on, "a", "na", "a0", "a1").join(y.toDF(*on, "b", "nb", "b0", "b1"), list(on))
    lacking = F.expr(f"bit_count(a0 & ~b0) + bit_count(a1 & ~b1) <= na - na * {share}D + 1e-6D")
    kept = lambda met: met.where(F.expr("a <> b AND (na < nb OR na = nb AND a < b)") & lacking).select(key, "a", "b")
    long = classes.groupBy(key).agg(F.count("*").alias("sentences")).where(F.col("sentences") > whole)
    if not long.limit(1).count():
        return kept(sides(narrow, narrow, key)).distinct()
    short = narrow.join(long, key, "left_anti")
    grouped = classes.join(long, key).withColumn("groups", F.greatest(F.lit(2), F.floor(F.col("sentences") / GROUP)))
    # long words are rare more often than not; the order decides the cost only
    probes = F.expr(f"slice(array_sort(transform(content, x -> struct(-length(x) AS l, x AS w))), 1, cast(size - ceil(size * {share}D - 1e-9D) + 1 AS INT)).w")
    dealt = lambda words: grouped.withColumn("_w", words).select(key, F.explode(F.expr("array_distinct(transform(_w, x -> pmod(xxhash64(x), groups)))")).alias("g"), "first", "size", "s0", "s1")
    return kept(sides(short, short, key)).unionByName(kept(sides(dealt(probes), dealt(F.col("content")), key, "g"))).distinct()


def repeated_sentences_of(rows: DataFrame, key: str, order: str, share: float = 0.8, at: str | None = None, whole: int = WHOLE) -> DataFrame:
    """(key, order, twin): sentences of rows (key, order, sentence) that say what an earlier one of their key says, with the earliest such one. at: a folder to save the facts in, so
    that they are worked out once. Only digests and bitmaps of all sentences are shuffled; facts are fetched for the pairs that pass the sieve."""
    spark, same = rows.sparkSession, [key, "d1", "d2"]

    def saved(df: DataFrame, name: str) -> DataFrame:
        if not at:
            return df
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    few = lambda df: F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
    digest = [F.xxhash64(*FACTS).alias("d1"), F.xxhash64(*reversed(FACTS), F.lit(7)).alias("d2")]
    facts = saved(sentence_facts(rows.where(F.col(key).isNotNull())).select(key, order, *FACTS, *digest, F.size("content").alias("size"), _signature(0).alias("s0"), _signature(1).alias("s1")), "facts")
    twice = few(saved(facts.groupBy(*same).agg(F.min(order).alias("_least"), F.count("*").alias("n")).where("n > 1").drop("n"), "twice"))
    known = facts.join(twice, same, "left").withColumn("first", F.coalesce("_least", order))
    classes = known.where(F.col("first") == F.col(order))
    met = saved(_candidates(classes, key, share, whole), "met")
    ids = few(saved(met.select(key, F.explode(F.array("a", "b")).alias("first")).distinct(), "ids"))
    some = classes.join(ids, [key, "first"], "left_semi")
    of = lambda p: some.select(key, F.col("first").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in FACTS])
    side = lambda p: {c: F.col(f"{p}_{c}") for c in FACTS}
    shared = F.size(F.array_intersect("a_content", "b_content")) >= F.size("a_content") * share - 1e-9
    found = met.join(of("a"), [key, "a"]).join(of("b"), [key, "b"]).where(shared & same_finding(side("a"), side("b"))).select(key, "a", "b")
    least = few(saved(found.unionByName(found.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(key, F.col("a").alias("first")).agg(F.min("b").alias("near")), "near"))
    out = known.select(key, order, "first").join(least, [key, "first"], "left").withColumn("twin", F.least("first", F.coalesce("near", "first")))
    return out.where(F.col("twin") < F.col(order)).select(key, order, "twin")


_IN = lambda x, words: f"list_contains([{', '.join(repr(w) for w in words)}], {x})"
_CONTENT = lambda x: f"length({x}) > 1 AND NOT {_IN(x, STOP)}"
_SET = "list_sort(list_distinct({}))"
_CASE = lambda x, table_: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"
_Q = lambda form: form.replace("'", "''")
_INSIDE = lambda a, b: f"len(list_filter(list_distinct({a}), lambda v: len(list_filter({a}, lambda z: z = v)) > len(list_filter({b}, lambda z: z = v)))) = 0"
_CLASHES = lambda a, b: f"len(list_filter({a}.denied, lambda v: list_contains({b}.content, v) AND NOT list_contains({b}.negated, v))) > 0"
_OF_KIND = lambda f, kind: f"list_filter({f}.marks, lambda v: starts_with(v, '{kind}:'))"
_AGREE = lambda kind: f"(len({_OF_KIND('x', kind)}) = 0 OR len({_OF_KIND('y', kind)}) = 0 OR len(list_intersect({_OF_KIND('x', kind)}, {_OF_KIND('y', kind)})) = least(len({_OF_KIND('x', kind)}), len({_OF_KIND('y', kind)})))"
_REPEATS = (
    "WITH "
    + sentences_sql("documents")
    + rf""", t AS (SELECT doc_id, n AS place, sentence, regexp_extract_all(lower(sentence), '{_Q(_WORD)}') AS w, regexp_replace(lower(sentence), '{_FREE}', 'no \1', 'g') AS plain, regexp_extract_all(sentence, '{_FIGURE}') AS figs FROM sentences),
k AS (SELECT *, list_transform(string_split_regex(plain, '{_CLAUSE}'), lambda c: regexp_extract_all(c, '{_Q(_WORD)}')) AS clauses FROM t WHERE len(w) >= 5),
g AS (SELECT doc_id, place, w, figs, sentence, flatten(clauses) AS p, {_SET.format(f"list_filter(w, lambda x: {_CONTENT('x')})")} AS content,
  flatten(list_transform(clauses, lambda c: flatten(list_transform(list_filter(range(1, len(c) + 1), lambda i: {"list_contains(string_split('" + ",".join(x.replace("'", "''") for x in NEGATIONS) + "', ','), replace(c[i], '’', chr(39)))"}), lambda i: list_filter(c[i + 1:], lambda x: {_CONTENT('x')} AND NOT {_IN('x', FILLER)})[1:2])))) AS r FROM k),
h AS (SELECT doc_id, place, content, list_sort(list_filter(figs, lambda f: NOT regexp_matches(f, '{_DATE}'))) AS figures,
  {_SET.format(f"list_concat(list_filter(figs, lambda f: regexp_matches(f, '{_DATE}')), list_filter(list_transform(w, lambda x: {_CASE('x', _TIME_OF)}), lambda x: x IS NOT NULL))")} AS times, {_SET.format('r')} AS negated,
  list_filter({_SET.format('r')}, lambda v: len(list_filter(p, lambda z: z = v)) <= len(list_filter(r, lambda z: z = v))) AS denied,
  {_SET.format(f"list_concat(list_filter(list_transform(w, lambda x: {_CASE('x', _MARK_OF)}), lambda x: x IS NOT NULL), list_transform(regexp_extract_all(replace(sentence, ' ', '  '), '{_SIDE}', 1), lambda s: CASE WHEN starts_with(s, 'L') THEN 'side:left' ELSE 'side:right' END))")} AS marks FROM g WHERE len(content) >= 3),
c AS (SELECT doc_id, {", ".join(FACTS)}, min(place) AS first FROM h GROUP BY ALL),
u AS (SELECT doc_id, first, len(content) AS size, unnest(content) AS w FROM c),
m AS (SELECT a.doc_id, a.first AS a, b.first AS b FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.w = b.w AND a.first <> b.first AND a.size <= b.size GROUP BY 1, 2, 3, a.size HAVING count(*) >= a.size * 0.8::DOUBLE - 1e-9),
v AS (SELECT m.* FROM m JOIN c x ON x.doc_id = m.doc_id AND x.first = m.a JOIN c y ON y.doc_id = m.doc_id AND y.first = m.b
  WHERE ({_INSIDE('x.figures', 'y.figures')} OR {_INSIDE('y.figures', 'x.figures')}) AND NOT ({_CLASHES('x', 'y')}) AND NOT ({_CLASHES('y', 'x')}) AND (len(x.times) = 0 OR len(y.times) = 0 OR len(list_intersect(x.times, y.times)) > 0) AND {" AND ".join(map(_AGREE, CONTRAST))}),
n AS (SELECT doc_id, first, min(near) AS near FROM (SELECT doc_id, a AS first, b AS near FROM v UNION ALL SELECT doc_id, b, a FROM v) GROUP BY 1, 2)
SELECT h.doc_id, h.place, least(c.first, coalesce(n.near, c.first)) AS twin FROM h JOIN c ON h.doc_id = c.doc_id AND {" AND ".join(f"h.{f} = c.{f}" for f in FACTS)} LEFT JOIN n ON n.doc_id = c.doc_id AND n.first = c.first
WHERE least(c.first, coalesce(n.near, c.first)) < h.place"""
)


@query(_REPEATS)
def near_dup_sentences(spark, sf_dir):
    """Sentences of a document that say again what an earlier one of it says; place is the sentence's number."""
    from wardflow.streaming.jobs import work_folder

    s = split_sentences(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("n").alias("place"), "sentence")
    return repeated_sentences_of(s, "doc_id", "place", at=work_folder(spark, "facts"))
