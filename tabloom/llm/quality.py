"""Quality classifier: a sparse ensemble of rules compiled into column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, text_or_empty

#: Marks whose share of the text is a statistic each.
_MARKS = {"bangs": "!", "pipes": "|", "breaks": "\n"}
_JUNK = "&#$%*"


def statistics(text: Column) -> list[Column]:
    """Statistics of a text as named double columns, all from built-in functions.

    Shares are of characters or words; the empty text has length 0 and shares 0.
    """
    chars, words = F.length(text), F.split(F.trim(text), "\\s+")
    some = F.greatest(chars, F.lit(1))
    lines = F.split(text, "\n")

    def share(mark: str) -> Column:
        return (chars - F.length(F.replace(text, F.lit(mark), F.lit("")))) / some

    repeated = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit("\0").alias("last")),
                           lambda a, w: F.struct((a["n"] + (a["last"] == w).cast("int")).alias("n"), w.alias("last")),
                           lambda a: a["n"])
    found = {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": chars / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "repeated_words": repeated / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(chars / F.size(lines)),
        "capitals": F.length(F.regexp_replace(text, "\\P{Lu}+", "")) / some,
        "letters": F.length(F.regexp_replace(text, "\\P{L}+", "")) / some,
        "digits": F.length(F.regexp_replace(text, "[^0-9]+", "")) / some,
        "junk": sum((share(m) for m in _JUNK[1:]), share(_JUNK[0])),
        **{name: share(mark) for name, mark in _MARKS.items()},
    }
    return [value.cast("double").alias(name) for name, value in found.items()]


STATISTICS = ["log_words", "word_length", "distinct_words", "repeated_words", "distinct_lines", "line_length", "capitals",
              "letters", "digits", "junk", *_MARKS]


def with_statistics(docs: DataFrame, into: str = "__stats") -> DataFrame:
    """Add one struct column of statistics. The one-row explode keeps Catalyst from
    copying the expressions into every rule that names a statistic."""
    return docs.select("*", F.explode(F.array(F.struct(*statistics(text_or_empty())))).alias(into))


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions: each rule is ((statistic, "<=" or ">", threshold), ...)."""

    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]
    intercept: float

    def score(self, stats: str = "__stats") -> Column:
        """Probability of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule, stats: str = "__stats") -> Column:
    """A conjunctive rule as a boolean column."""
    test = F.lit(True)
    for name, sign, threshold in rule:
        value = F.col(f"{stats}.{name}")
        test = test & (value <= F.lit(threshold) if sign == "<=" else value > F.lit(threshold))
    return test


def tree_paths(description: str) -> list[tuple[tuple[str, str, float], ...]]:
    """All paths from a root to a node in the text form of a tree ensemble, once each,
    with at most one lower and one upper bound for each statistic."""
    path, found = [], {}
    for line in description.splitlines():
        step = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.lstrip().startswith("Tree "):
            path = []
        if not step:
            continue
        depth = (len(line) - len(line.lstrip()))
        path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(step[1])], step[2], float(step[3]))]
        bounds = {}
        for _, name, sign, value in path:
            key = (name, sign)
            bounds[key] = value if key not in bounds else (min if sign == "<=" else max)(bounds[key], value)
        found[tuple(sorted((n, s, v) for (n, s), v in bounds.items()))] = True
    return list(found)


def fit(stats: DataFrame, labels: DataFrame, trees: int = 24, depth: int = 3, lasso: float = 2e-4, seed: int = 7) -> RuleModel:
    """Fit on rows of ``stats`` (doc_id, __stats) that have a label (doc_id, label 0/1).

    Random trees over the statistics propose rules (every path from a root); a
    logistic regression with a lasso penalty weighs them, and those with weight
    zero are dropped. Both fits are distributed and see every labelled row. Null
    ids and labels are ignored. With one class only, or none, the score is the
    smoothed share of label 1.
    """
    rows = stage(stats.join(labels.where("label is not null").select(F.col("doc_id"), F.col("label").cast("double").alias("label")), "doc_id")
                 .select("label", *[F.col(f"__stats.{c}").alias(c) for c in STATISTICS], "__stats"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        from math import log
        return RuleModel((), log((ones + 1) / (n - ones + 1)))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = tree_paths(forest.toDebugString)
    hits = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(hits).select("label", "features").persist()
    try:
        fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True).fit(hits)
    finally:
        hits.unpersist()
    weights = fitted.coefficients.toArray()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(fitted.intercept))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that no fit may see: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, RuleModel]:
    """((doc_id, held_out, score, predicted) for every row of ``docs``, the model).

    ``labels`` holds (doc_id, label); only ids outside the held-out fold teach.
    Whole texts count; null texts are empty, empty texts get a score too, repeated
    rows come back repeated, and no column but the text enters a score.
    """
    stats = stage(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "__stats"))
    model = fit(stats, labels.where(~held_out()))
    out = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns as they are.

    Null and empty texts are scored like any other, repeated rows are all kept or all
    dropped, null ids never teach, an empty table gives an empty one, and other columns
    may have any name. The filter works the statistics out a second time instead of
    reading them beside staged rows, which would write every text once more.
    """
    name = free_name(docs.columns, "__stats")
    model = classify(docs, labels, threshold)[1]
    return with_statistics(docs, name).where(model.score(name) >= threshold).drop(name)
