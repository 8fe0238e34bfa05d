"""Quality classifier: regularised quadratic discriminant on document statistics.

A text becomes a vector of transformed statistics (logarithms of sizes, square
roots of shares). For each class, Spark adds up the vectors and their products
over all labelled rows; the covariance is shrunk towards a multiple of the
identity by the factor that the class's own size suggests, and its Cholesky
factor is computed once and sent to the tasks. The score is the logistic
function of the difference of log densities (half squared Mahalanobis lengths
and log determinants) plus the log prior odds.

Defined results: null and empty texts have the vector of an empty text and are
scored like any other; ids with several labels count as good only if none says
otherwise; with one class the score is the share of that class (1 or 0),
without labels 0.5; repeated rows give equal rows, an empty table an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.session import stage_table

# Characters counted by class; each share enters by its square root.
COUNTED = {
    "symbols": r"[^#*$%&|<>@{}\[\]\\^~=+]+",
    "capitals": r"[^\p{Lu}]+",
    "digits": r"[^0-9]+",
    "shouts": r"[^!?]+",
    "stops": r"[^.,;:]+",
    "pipes": r"[^|]+",
}
FEATURES = ("log_words", "word_length", "distinct_words", "pair_repeats", "line_words", "distinct_lines", "edge_lines",
            *COUNTED)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of every row's whole text."""
    words, lines = F.col("_w"), F.col("_l")
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda part, whole: F.sqrt(F.least(part / whole, F.lit(4.0)))
    chars = F.greatest(F.length("_t"), F.lit(1))
    out = {
        "log_words": F.log1p(F.size(words)),
        "word_length": F.log1p(F.length(F.array_join(words, "")) / n),
        "distinct_words": F.size(F.array_distinct(words)) / F.pow(n, F.lit(0.85)),
        # Words equal to the word before.
        "pair_repeats": share(F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))), n),
        "line_words": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        # Lines that end without a full stop or the like.
        "edge_lines": share(F.size(F.filter(lines, lambda x: ~F.right(x, F.lit(1)).isin(".", "!", "?", '"'))),
                            F.greatest(F.size(lines), F.lit(1))),
        **{name: share(F.length(F.regexp_replace("_t", others, "")), chars) for name, others in COUNTED.items()},
    }
    return (docs.select(*keep, C.whole_text().alias("_t"))
            .withColumn("_w", C.space_words(F.col("_t")))
            .withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x != ""))
            .select(*keep, *[v.cast("double").alias(k) for k, v in out.items()]))


@dataclass
class Discriminant:
    """Means, Cholesky factors and log densities' constants of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(constant - 0.5 * (z * z).sum(axis=0))
        return density[1] - density[0]


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """label -> (rows, sum of vectors, sum of products), added up by Spark."""
    d = len(FEATURES)
    at = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in at]
    out = {}
    for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        second = np.zeros((d, d))
        for i, j in at:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), second)
    return out


def fit(rows: DataFrame, shrink: float | None = None) -> Discriminant | float:
    """From labelled vectors; a bare share of class 1 where two classes are not there.

    ``shrink`` None: d / (n + d) of a class with n rows, at least one per cent.
    """
    found = _moments(rows)
    if set(found) != {0, 1}:
        return 0.5 if not found else float(1 in found)
    d = len(FEATURES)
    pooled_n = sum(n for n, _, _ in found.values())
    means = {k: s / n for k, (n, s, _) in found.items()}
    pooled = sum(p - n * np.outer(means[k], means[k]) for k, (n, _, p) in found.items()) / pooled_n
    scale = np.maximum(np.diag(pooled), 1e-6)
    factors, constants = [], []
    for k in (0, 1):
        n, _, p = found[k]
        covariance = p / n - np.outer(means[k], means[k])
        part = max(0.01, d / (n + d)) if shrink is None else shrink
        covariance = (1 - part) * covariance + part * np.diag(scale)
        factor = np.linalg.cholesky(covariance + 1e-9 * np.eye(d))
        factors.append(factor)
        constants.append(np.log(n / pooled_n) - np.log(np.diag(factor)).sum())
    return Discriminant(np.stack([means[0], means[1]]), np.stack(factors), np.array(constants))


def score(vectors: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id and the score of every row of ``vectors`` (doc_id and FEATURES)."""
    if isinstance(model, float):
        return vectors.select("doc_id", F.lit(model).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            odds = np.clip(model.log_odds(x), -30, 30) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])
    return vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), *FEATURES).mapInArrow(
        run, "doc_id bigint, score double")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's quality, from labels of the documents that are not held out."""
    held_out = C.is_held_out(F.col("doc_id"), 5, 0)
    vectors = stage_table(features(C.table(spark, sf_dir, "documents"), ["doc_id"]), "vectors")
    labels = (C.table(spark, sf_dir, "labels").where(~held_out & F.col("quality").isin(0, 1))
              .groupBy("doc_id").agg(F.min("quality").alias("label")))
    model = fit(vectors.where(~held_out).join(labels, "doc_id"))
    return score(vectors, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
