"""Quality classifier: a sparse rule ensemble.

Trees grown on text statistics give their root-to-node paths as conjunctive rules; an L1-penalised logistic regression
weighs the rules and drops most; what is left is one Spark column. Labels are learnt only from rows whose
crc32(doc_id as text) mod 5 is not 0, at most FIT_ROWS of them, chosen by a hash of doc_id.

Defined cases: null and empty texts have statistics of 0 and get a score like any other; null labels are left out; of
several labels for one document the smallest holds; null doc_ids are never held out; with no labels, labels of one
class only or too few rows for any rule, the score is the smoothed share of label 1; equal rows get equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm._util import Workspace
from wardflow.llm.quality_rules import features, text_stats

FIT_ROWS = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.002
CUT = 0.3
SEED = 11

#: A rule: for each feature the interval (above, at most) that its value must lie in.
Rule = tuple[tuple[str, float | None, float | None], ...]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def measured() -> list[Column]:
    """Each feature as a column x_<name>."""
    return [c.alias(f"x_{n}") for n, c in features().items()]


def rule_text(rule: Rule) -> str:
    """The rule as a condition over the columns of `measured`."""
    tests = [f"x_{name} > {above!r}D" for name, above, _ in rule if above is not None] + [f"x_{name} <= {most!r}D" for name, _, most in rule if most is not None]
    return " AND ".join(tests) or "true"


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Paths from the root to every other node of every tree, bounds merged, each rule once."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float | None, float | None]]) -> None:
        if bounds:
            found[tuple((n, *b) for n, b in sorted(bounds.items()))] = None
        if node.subtreeDepth() == 0:
            return
        name, value = names[node.split().featureIndex()], float(node.split().threshold())
        above, most = bounds.get(name, (None, None))
        walk(node.leftChild(), bounds | {name: (above, value if most is None else min(most, value))})
        walk(node.rightChild(), bounds | {name: (value if above is None else max(above, value), most)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


@dataclass
class Ensemble:
    intercept: float
    weighted: list[tuple[float, Rule]]

    def column(self) -> Column:
        """The probability of label 1, over the columns of `measured`."""
        terms = [f"{self.intercept!r}D", *[f"CASE WHEN {rule_text(rule)} THEN {weight!r}D ELSE 0D END" for weight, rule in self.weighted]]
        return F.expr(f"1 / (1 + exp(-({' + '.join(terms)})))")


def fit(stats: DataFrame, labels: DataFrame, space: Workspace, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Learns from statistics by doc_id and labels (doc_id, quality)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    part = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    names = list(features())
    rows = space.save(stats.join(known, "doc_id").select("label", *measured()), "fit").coalesce(2)
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    share = ((ones or 0) + 0.5) / (n + 1)
    constant = Ensemble(math.log(share / (1 - share)), [])
    if not n or not ones or ones == n:
        return constant
    x = rows.withColumn("features", array_to_vector(F.array(*[f"x_{n}" for n in names])))
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=48, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED, minInstancesPerNode=10).fit(x.select("label", "features"))
    rules = tree_rules(trees, names)
    if not rules:
        return constant
    hits = space.save(rows.select("label", F.expr(f"array({', '.join(f'CAST({rule_text(r)} AS DOUBLE)' for r in rules)})").alias("hits")), "hits").coalesce(2).select("label", array_to_vector("hits").alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(hits)
    return Ensemble(float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients, rules, strict=True) if abs(w) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document."""
    stats = space.save(text_stats(docs, "doc_id"), "stats")
    model = fit(stats, labels, space)
    return stats.select("doc_id", *measured()).select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
