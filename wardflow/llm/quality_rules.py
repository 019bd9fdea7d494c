"""Quality rules as a learned decision list.

Statistics of whole texts, then sequential covering over labelled rows: each rule grows by the condition with the
best FOIL gain on two thirds of the rows, is pruned on the rest, and the rows it covers leave before the next one
grows. Every step is one grouped count over binned statistics. The list becomes one ordered Spark conditional.

Defined cases: null and empty texts have no words and fail the base rule; null labels are left out; of several labels
for one document the smallest holds; without labels the list is empty and only the base rule rejects; equal rows are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace, words

#: Labelled rows to learn from at most (chosen by a hash of doc_id).
FIT_ROWS = 20_000
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
FEATURES = ("mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "distinct_share", "repeat_share", "dup_line_share", "line_words", "n_words")
BLANK = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words lying in three-word windows that the text holds twice or more."""

    def covered(h: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(at, marked), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    counted = docs.select(*keep, words(F.col("text")).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANK)).alias("_lines"), count(r"[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("n_upper"), count(r"\d").alias("n_digits"), count(r"[.,;:!?]").alias("n_punct"))
    return counted.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        "n_upper",
        "n_digits",
        "n_punct",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word": part("word_chars", "n_words"),
        "symbol_share": part("n_symbols", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
        "digit_share": part("n_digits", "word_chars"),
        "punct_share": part("n_punct", "n_words"),
        "distinct_share": part("n_distinct", "n_words"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "line_words": part("n_words", "n_lines"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass
class Rule:
    """A conjunction of (feature, at most / above, threshold); it rejects."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, value in self.conditions:
            out = out & ((features()[name] > value) if above else (features()[name] <= value))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>' if a else '<='} {v:.6g}" for n, a, v in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, space: Workspace, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list, from statistics of documents and labels (doc_id, quality); quality 0 is to be rejected."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    rows = stats.join(known, "doc_id").where(~base_failed()).select("doc_id", (F.col("quality") == 0).alias("bad"), F.array(*features().values()).alias("x"))
    rows = space.save(rows, "fit")
    cuts = rows.agg(*[F.percentile_approx(F.col("x")[i], [k / BINS for k in range(1, BINS)], 10_000).alias(f"c{i}") for i in range(len(FEATURES))]).first()
    cuts = [sorted(set(c or [])) for c in cuts]
    bins = F.array(*[_bin(F.col("x")[i], c) for i, c in enumerate(cuts)])
    rows = space.save(rows.select("bad", bins.alias("b"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held")), "binned").coalesce(4)
    left, found = rows, []
    for _ in range(MAX_RULES):
        conds: list[tuple[int, bool, int]] = []
        grown = left.where("NOT held")
        for _ in range(MAX_CONDITIONS):
            counts = grown.select("bad", F.posexplode("b").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best, p0, n0 = (0.0, None), sum(r.p for r in counts if r.f == 0), sum(r.n for r in counts if r.f == 0)
            if not p0 or not n0:
                break
            for i, cut in enumerate(cuts):
                got = {r.bin: (r.p, r.n) for r in counts if r.f == i}
                p = n = 0
                for k in range(len(cut)):
                    p, n = p + got.get(k, (0, 0))[0], n + got.get(k, (0, 0))[1]
                    best = max(best, (_gain(p, n, p0, n0), (i, False, k)), (_gain(p0 - p, n0 - n, p0, n0), (i, True, k)), key=lambda x: x[0])
            if not best[1]:
                break
            conds.append(best[1])
            grown = grown.where(_test(best[1]))
        if not conds:
            break
        tests = [_all(conds[: k + 1]) for k in range(len(conds))]
        held = left.where("held").agg(*[F.count_if(t & F.col("bad")).alias(f"p{k}") for k, t in enumerate(tests)], *[F.count_if(t & ~F.col("bad")).alias(f"n{k}") for k, t in enumerate(tests)]).first()
        worth = [((held[f"p{k}"] - held[f"n{k}"]) / (held[f"p{k}"] + held[f"n{k}"]) if held[f"p{k}"] + held[f"n{k}"] else -1.0, -k) for k in range(len(conds))]
        value, k = max(worth)
        conds = conds[: 1 - k]
        if value < 2 * MIN_PRECISION - 1:
            break
        found.append(Rule([(FEATURES[i], above, cuts[i][c]) for i, above, c in conds]))
        left = left.where(~_all(conds))
    return found


def _bin(value: Column, cut: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in cut]), lambda v: v < value)) if cut else F.lit(0)


def _test(cond: tuple[int, bool, int]) -> Column:
    i, above, k = cond
    return F.col("b")[i] > k if above else F.col("b")[i] <= k


def _all(conds: list[tuple[int, bool, int]]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & _test(c)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the rule that rejects, or 0."""
    out = F.when(base_failed(), F.lit(-1))
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the number of the rejecting rule, -1 base, 0 none), kept."""
    stats = space.save(text_stats(docs, "doc_id"), "stats")
    rules = learn(stats, labels, space)
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", F.col("rule") == 0)


def keep_good(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """The documents that the list keeps, unchanged. Their statistics are worked out once and saved beside each row."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = space.save(text_stats(packed, "doc_id", "_row"), "judged")
    return judged.where(verdict(learn(judged.drop("_row"), labels, space)) == 0).select("_row.*")
