"""Quality classifier: a sparse ensemble of tree-path rules over text statistics, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larkspur.llm.common import LOWER, SOLID_BYTE, chunks, raw_bytes, released, text_column, word_hashes, word_spans
from larkspur.llm.training import held_out, labelled_docs
from larkspur.session import checkpointed

#: Statistics of a text, all rates of its bytes, words or lines but the first (log10 of 1 + words).
STATISTICS = ("words", "word_bytes", "upper", "digit", "mark", "sign", "bar", "bang", "beyond_ascii", "line_words", "repeat", "distinct", "longest_run")
_BYTES = {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "mark": b".,;:?'\"()-",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "bar": b"|",
    "bang": b"!",
    "beyond_ascii": range(0x80, 0x100),
}
#: Size of the forest, rules at most, lasso penalty, iterations and tolerance of its fit, and the score from which a text is good.
TREES, DEPTH, RULES, PENALTY, ITERATIONS, TOLERANCE, THRESHOLD = 24, 3, 400, 0.0005, 60, 1e-4, 0.7
#: Tasks over the bounded sample: it has some thousand short rows, and each step of a fit is a job.
SAMPLE_TASKS = 4


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; zeros (and distinct 1) for an empty one."""
    size, rows = np.diff(offsets), len(offsets) - 1
    starts, stops, first = word_spans(data, offsets, SOLID_BYTE)
    n = np.diff(first)
    h = word_hashes(LOWER[data], starts, stops)
    row = np.repeat(np.arange(rows), n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(h)))) if len(h) else np.zeros(0, np.int64)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, run)
    some, words = np.maximum(size, 1), np.maximum(n, 1)
    out = {"words": np.log10(1.0 + n), "word_bytes": _sums(stops - starts, first) / words, "line_words": np.minimum(n / (1 + _sums(data == 10, offsets)), 200.0)}
    for name, members in _BYTES.items():
        member = np.zeros(256, bool)
        member[list(members)] = True
        out[name] = _sums(member[data], offsets) / some
    out |= {"repeat": _sums(again, first) / words, "distinct": np.where(n > 0, _sums(new, first) / words, 1.0), "longest_run": np.minimum(longest, 100).astype(float)}
    return np.column_stack([out[k] for k in STATISTICS])


def _column(name: str) -> str:
    """Name of a statistic's column, unlike any that a table of documents has."""
    return f"__statistic_{name}"


def with_statistics(rows: DataFrame) -> DataFrame:
    """`rows` with a column for each statistic of `text` (null: empty)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in chunks(column):
                found = statistics(*raw_bytes(column.slice(a, b - a)))
                part = batch.slice(a, b - a)
                names = [*part.schema.names, *map(_column, STATISTICS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(x)) for x in found.T)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(measured(batches))

    schema = StructType([*rows.schema.fields, *(StructField(_column(s), DoubleType()) for s in STATISTICS)])
    return rows.mapInArrow(run, schema)


#: A rule is a set of (statistic, ">" or "<=", threshold) that all hold.
Rule = frozenset[tuple[int, str, float]]


def tree_rules(description: str) -> list[Rule]:
    """The paths from the root to every node of the trees in a forest's description."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.lstrip().startswith("Tree "):
            path = []
        elif m:
            deep = len(m[1])
            path = [p for p in path if p[0] < deep] + [(deep, (int(m[2]), m[3], float(m[4])))]
            found[frozenset(c for _, c in path)] = None
    return list(found)


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for f, sign, at in sorted(rule):
        c = F.col(_column(STATISTICS[f]))
        out = out & (c > F.lit(at) if sign == ">" else c <= F.lit(at))
    return out


@dataclass
class RuleEnsemble:
    """Weighted rules; `score` is the logistic of their sum."""

    base: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Spark column over the statistics, between 0 and 1."""
        total = F.lit(self.base)
        for rule, w in self.weights:
            total = total + F.when(_holds(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
    """Fit rules on the bounded labelled sample: paths of a shallow forest, weighted by a lasso logistic regression.

    Without labelled rows, with one class only, or where no statistic parts the classes, there are no rules and the score is
    the (smoothed) share of label 1.
    """
    sample = checkpointed(with_statistics(labelled_docs(docs, labels, label)).drop("text"))
    share = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    constant = RuleEnsemble(float(np.log((share.ones + 1) / (share.n - share.ones + 1))), [])
    if share.ones in (0, share.n):
        return constant
    rows = sample.select("label", *map(_column, STATISTICS), array_to_vector(F.array(*map(_column, STATISTICS))).alias("x")).coalesce(SAMPLE_TASKS).cache()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=7)
    rules = tree_rules(forest.fit(rows).toDebugString)[:RULES]
    if not rules:
        rows.unpersist()
        return constant
    binary = rows.select("label", array_to_vector(F.array(*(_holds(r).cast("double") for r in rules))).alias("r")).cache()
    model = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=ITERATIONS, tol=TOLERANCE).fit(binary)
    rows.unpersist()
    binary.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(float(model.intercept), weights)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be of label 1."""
    model = fit(docs, labels)
    return with_statistics(docs).where(model.score() >= THRESHOLD).select(*docs.columns)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; null texts score as empty ones."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_statistics(rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
