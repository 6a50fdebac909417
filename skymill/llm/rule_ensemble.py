"""Quality classifier as a sparse rule ensemble over text statistics.

Trees are grown on statistics of labelled texts; every path from a root to a node is a conjunctive rule. A logistic
regression with an L1 penalty over the rules keeps few of them. The kept rules are compiled into one Spark column
expression over the statistics, so scoring is a projection that runs in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, row_key, text_of
from skymill.runtime import cut

MAX_TRAINING_ROWS = 40_000  # labelled rows the ensemble is fitted on at most, the first by a hash of the id
TREES, DEPTH, LASSO = 24, 4, 0.0005
CUTOFF = 0.3

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "upper_share", "digit_share", "beyond_ascii_share", "exclaimed", "barred", "starred",
    "other_marks", "sentence_marks", "distinct_words", "repeated_next", "lines", "distinct_lines", "short_words", "upper_words",
)

_DIGITS, _UPPER, _LOWER = range(48, 58), range(65, 91), range(97, 123)
_STARRED = [ord(c) for c in "*#$%&"]
_OTHER = [ord(c) for c in "@^~_=+<>{}[]\\/\"'`:;()-"]


def statistics(text: str) -> list[float]:
    """Values of ``STATISTICS``; shares and rates are 0 for an empty text."""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    upper, lower = n[_UPPER.start : _UPPER.stop].sum(), n[_LOWER.start : _LOWER.stop].sum()
    lines = [x for x in data.split(b"\n") if x]
    return [
        float(len(text)),
        float(len(words)),
        float(sizes.mean()),
        float(sizes.max()),
        float(upper / max(upper + lower, 1)),
        float(n[_DIGITS.start : _DIGITS.stop].sum() / len(data)),
        float(n[128:].sum() / len(data)),
        float(n[33] / w),
        float(n[124] / w),
        float(n[_STARRED].sum() / w),
        float(n[_OTHER].sum() / w),
        float((n[44] + n[46]) / w),
        len(set(words)) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        float(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        float((sizes <= 3).mean()),
        sum(map(bytes.isupper, words)) / w,
    ]


def _measured(text: Column) -> Column:
    """The statistics as one struct."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), index=texts.index, dtype="float64")

    return measure(text)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, _key`` and the statistics of every row's whole text; null counts as empty."""
    rows = bounded_batches(docs).select("doc_id", row_key().alias("_key"), _measured(text_of()).alias("_s"))
    return rows.select("doc_id", "_key", *[F.col(f"_s.{s}").alias(s) for s in STATISTICS])


def held_out() -> Column:
    """Rows that labels are never learned from: crc32 of the id as text divides by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (statistic, '<=' or '>', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"{name} {op} {threshold!r}D" for name, op, threshold in self.conditions)

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(table), dtype=bool)
        for name, op, threshold in self.conditions:
            out &= (table[name] <= threshold if op == "<=" else table[name] > threshold).to_numpy()
        return out


@dataclass
class Ensemble:
    intercept: float
    weighted: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        terms = [F.when(F.expr(r.sql()), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weighted]
        z = F.lit(self.intercept)
        for t in terms:
            z = z + t
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)")


def rules_of_tree(description: str, names: Sequence[str] = STATISTICS) -> set[Rule]:
    """Every path from the root of a tree, given as Spark's indented text, to a node below it."""
    found, path = set(), []
    for line in description.splitlines():
        m = _SPLIT.search(line)
        if m:
            depth = len(line) - len(line.lstrip())
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.add(Rule(_simplified([c for _, c in path])))
    return found


def _simplified(conditions: list[tuple[str, str, float]]) -> tuple[tuple[str, str, float], ...]:
    """One bound per statistic and side."""
    tight: dict[tuple[str, str], float] = {}
    for name, op, t in conditions:
        old = tight.get((name, op))
        tight[name, op] = t if old is None else (min if op == "<=" else max)(old, t)
    return tuple(sorted((name, op, t) for (name, op), t in tight.items()))


def labelled(labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``_id, label``: at most ``max_rows`` ids to learn from, one row per id, the first by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("double").alias("label"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)


def fit(stats: DataFrame, labels: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, max_rows: int = MAX_TRAINING_ROWS) -> Ensemble:
    """Fit on the rows of ``stats`` that have a label and are not ``held_out``, at most ``max_rows`` of them.

    ``labels``: ``doc_id, quality``; ids labelled both ways count as 0, null labels are left out. Without labels of both
    kinds the ensemble is the smoothed share of label 1 alone.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = stats.join(labelled(labels, max_rows), F.col("doc_id") == F.col("_id")).select("label", *STATISTICS)
    training = cut(rows)
    n, good = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        p = (good + 1) / (n + 2)
        return Ensemble(float(np.log(p / (1 - p))), [])
    data = cut_vectors(VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(training))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=42, featureSubsetStrategy="sqrt").fit(data)
    rules = sorted(set().union(*[rules_of_tree(t.toDebugString) for t in forest.trees]), key=lambda r: r.conditions)
    if not rules:
        p = (good + 1) / (n + 2)
        return Ensemble(float(np.log(p / (1 - p))), [])
    marks = [F.when(F.expr(r.sql()), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(training.select("label", *marks))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(cut_vectors(held))
    weighted = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]
    return Ensemble(float(model.intercept), weighted)


def cut_vectors(df: DataFrame) -> DataFrame:
    """Training rows as a written table: the fits pass over it many times."""
    return cut(df.select("label", "features"))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """``doc_id, _key, held_out, score, predicted`` of every row of ``docs``.

    score: 0 to 1, higher where label 1 is likelier; only the text decides. predicted: 1 if score >= ``cutoff``, else 0.
    Null and empty texts get the score of an empty text. Repeated rows stay, an empty table gives no row.
    """
    stats = cut(with_statistics(docs))
    model = fit(stats, labels, **options)
    scored = stats.select("doc_id", "_key", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, max_rows: int = MAX_TRAINING_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as 1, with their columns, in one pass over the texts.

    Only labelled rows, at most ``max_rows``, are measured for the fit; that bounds what is broadcast.
    """
    some = cut(labelled(labels, max_rows))
    model = fit(with_statistics(docs.join(F.broadcast(some), docs["doc_id"] == some["_id"], "left_semi")), labels, max_rows=max_rows, **options)
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    measured = docs.select(whole.alias("_doc"), _measured(text_of()).alias("_s"))
    return measured.select("_doc", "_s.*").where(model.score() >= cutoff).select("_doc.*")
