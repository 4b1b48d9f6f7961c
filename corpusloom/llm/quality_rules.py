"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark column expressions. A random forest is grown on them; every path from a root to a
node is a conjunction of conditions, a candidate rule. A logistic regression with a lasso penalty weighs the rules,
most of them with zero. What is left is compiled into one Spark column expression, so scoring needs no model object
and no Python.

Learning uses a sample of ``bound`` labelled rows at most, the first by a hash of the key; scoring uses every row. Only
the text is an input, and of its statistics only those that a rule with a weight names are computed.

Defined results: a null text scores as an empty one. Equal texts score equal. Texts may be of any length and are read
whole. With no labelled row, or with one class only, every score is that class's share (0.5 if there is no row). A
label that is null or neither 0 nor 1, and one whose key is null, isn't learned from; a key that has several labels, or
several documents, counts once for each pair. Other columns pass through untouched, whatever their names; a column of
the name ``into`` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, unused

#: Labelled rows that are used at most.
BOUND = 20_000


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def statistics(df: DataFrame, text: str, into: str = "stats", only: set[str] | None = None) -> DataFrame:
    """df with a struct column of the text's statistics, all doubles and never null; those in ``only`` if it is given."""
    t, words, lines = (unused(f"{into}_{x}", df) for x in ("t", "w", "l"))
    n, w, k = F.length(t), F.size(words), F.size(lines)
    spaces = F.length(t) - F.length(F.regexp_replace(t, r"\s+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    # each with whether it needs the words and the lines
    parts = {
        "chars": (F.log1p(n.cast("double")), False, False),
        "words": (F.log1p(w.cast("double")), True, False),
        "letters": (_share(letters, n), False, False),
        "digits": (_share(F.length(F.regexp_replace(t, r"[^0-9]+", "")), n), False, False),
        "spaces": (_share(spaces, n), False, False),
        "capitals": (_share(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), letters), False, False),
        "marks": (_share(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,]+", "")), n), False, False),
        "stops": (_share(n - F.length(F.replace(F.replace(F.col(t), F.lit("."), F.lit("")), F.lit(","), F.lit(""))), w), True, False),
        "word_length": (_share(n - spaces, w), True, False),
        "distinct_words": (_share(F.size(F.array_distinct(words)), w), True, False),
        "distinct_lines": (_share(F.size(F.array_distinct(lines)), k), False, True),
        "line_words": (F.log1p(_share(w, k)), True, True),
        "bare_words": (_share(F.size(F.filter(words, lambda x: ~x.rlike(r"\p{L}"))), w), True, False),
    }
    wanted = {c: v for c, v in parts.items() if only is None or c in only}
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    if any(v[1] for v in wanted.values()):
        df = df.withColumn(words, F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    if any(v[2] for v in wanted.values()):
        df = df.withColumn(lines, F.filter(F.split(t, r"\n"), lambda x: x != ""))
    return df.withColumn(into, F.struct(*[v[0].alias(c) for c, v in wanted.items()])).drop(t, words, lines)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is at most, threshold) hold; ``weight`` adds to the log-odds of label 1."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: str) -> Column:
        """1.0 where the rule fires, else 0.0."""
        holds = F.lit(True)
        for name, at_most, threshold in self.conditions:
            x = F.col(stats)[name]
            holds = holds & ((x <= threshold) if at_most else (x > threshold))
        return holds.cast("double")


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: str) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.lit(r.weight) * r.column(stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(node, names: list[str], above: tuple[tuple[str, bool, float], ...] = ()) -> list[tuple]:
    """The conjunctions of all nodes under a tree's node, with one condition for each statistic and side."""
    found = [above] if above else []
    if node.subtreeDepth():
        name, cut = names[node.split().featureIndex()], node.split().threshold()
        for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
            rest = tuple(c for c in above if c[:2] != (name, at_most))
            found += paths(child, names, tuple(sorted((*rest, (name, at_most, cut)))))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str = "text", bound: int = BOUND) -> DataFrame:
    """(text, label) of the documents of ``bound`` labels at most, the first by a hash of the key. The chosen labels are
    small by that bound, so they are broadcast and no text is shuffled."""
    chosen = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("label")).where("label IN (0, 1) AND _key IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "label").limit(bound)
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).select("text", "label")


def grown(data: DataFrame, names: list[str], trees: int, depth: int, seed: int) -> tuple:
    """A random forest's trees on (label, v)."""
    forest = RandomForestClassifier(featuresCol="v", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(data)
    return forest, sorted({p for tree in forest.trees for p in paths(tree._call_java("rootNode"), names)})


def weighed(table: DataFrame, found: list[tuple], lasso: float) -> tuple[float, list[float]]:
    """(intercept, weights) of rules: a logistic regression on which of them fire, with the penalty lasso * |weights|."""
    fired = table.select("label", array_to_vector(F.array(*[Rule(p).column("stats") for p in found])).alias("v")).coalesce(1).cache()
    fit = LogisticRegression(featuresCol="v", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(fired)
    fired.unpersist()
    return float(fit.intercept), [float(w) for w in fit.coefficients.toArray()]


def fit(labelled: DataFrame, text: str, label: str, trees: int = 12, depth: int = 3, lasso: float = 0.003, seed: int = 7) -> Ensemble:
    """An ensemble learned from the rows with label 0 or 1; all of them, so give a sample of bounded size."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label")).where("label IN (0, 1)")
    table = stored(statistics(rows, "text").drop("text"), "quality-sample")
    names = table.schema["stats"].dataType.fieldNames()
    by_label = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    if len(by_label) < 2:
        share = sum(k * c for k, c in by_label.items()) / max(1, sum(by_label.values())) if by_label else 0.5
        return Ensemble(math.log(max(share, 1e-6) / max(1 - share, 1e-6)), ())
    # one order whatever the partitions were, so that the same rows give the same forest
    data = table.select("label", F.array(*[F.col("stats")[x] for x in names]).alias("x")).coalesce(1).sortWithinPartitions("label", "x")
    _, found = grown(data.select("label", array_to_vector("x").alias("v")), names, trees, depth, seed)
    intercept, weights = weighed(table, found, lasso)
    return Ensemble(intercept, tuple(Rule(p, w) for p, w in zip(found, weights) if w))


def score(df: DataFrame, ensemble: Ensemble, text: str = "text", into: str = "quality_score") -> DataFrame:
    """df with the column ``into``: the chance of label 1."""
    if not ensemble.rules:
        return df.withColumn(into, ensemble.score(""))
    stats = unused(f"{into}_stats", df)
    needed = {name for r in ensemble.rules for name, _, _ in r.conditions}
    return statistics(df, text, stats, needed).withColumn(into, ensemble.score(stats)).drop(stats)


def at_least(df: DataFrame, ensemble: Ensemble, least: float, text: str = "text") -> DataFrame:
    """The rows of df that score ``least`` or more. A plain filter would be pushed below the statistics and work them out
    anew for each condition of each rule; no filter passes the one-element array, so a row's are worked out once."""
    found, held = (unused(x, df) for x in ("quality_score", "quality_held"))
    scored = score(df, ensemble, text, found).select(*df.columns, F.explode(F.array(found)).alias(held))
    return scored.where(F.col(held) >= least).select(df.columns)
