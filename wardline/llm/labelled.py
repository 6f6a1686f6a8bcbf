"""Labelled rows, bounded samples of them, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import likely, staged


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _seen(labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    seen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    seen = staged(seen.withColumn("_order", F.xxhash64("doc_id")))
    return seen, {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}


#: Bits of the table of labelled ids; 2 MB.
FILTER_BITS = 1 << 24


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of every labelled row that may be learned from, and the classes' counts.

    The join is a shuffle at every size, as a broadcast of ids would grow with the labels; few texts of other rows are in it.
    """
    seen, counts = _seen(labels, label)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.schema["doc_id"].dataType == seen.schema["doc_id"].dataType:
        rows = likely(rows.where(F.col("doc_id").isNotNull() & ~held_out()), seen, "doc_id", FILTER_BITS)
    return staged(rows.join(seen.select("doc_id", "y").hint("merge"), "doc_id")), counts


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most per_class labelled rows of either class, by the order of a hash, and the classes' counts.

    Only the ids of the sample, bounded by per_class, are broadcast; the counts cover all labelled rows.
    """
    seen, counts = _seen(labels, label)
    picked = [seen.where(F.col("y") == y).orderBy("_order", "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return staged(rows), counts


class Logistic:
    """Logistic regression by Newton steps over standardised features, each row with a weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        keep = np.full(len(self.w), ridge)
        keep[-1] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (y - p)) - keep * self.w
            h = (z.T * (weight * p * (1 - p) + 1e-9)) @ z + np.diag(keep)
            step = np.linalg.solve(h, g)
            self.w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def of_table(rows: DataFrame, size: int, weights: dict[int, float], ridge: float = 1.0) -> Logistic:
        """The same over all rows (x array<double> of the size given, y) of a table, fitted by MLlib."""
        out = Logistic.__new__(Logistic)
        one = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(size) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        out.mean, out.scale = (np.array([one[f"{k}{i}"] for i in range(size)], float) for k in "ms")
        out.scale += 1e-9
        weight = F.when(F.col("y") == 1, weights[1]).otherwise(weights[0])
        total = rows.agg(F.sum(weight)).first()[0]
        standard = F.array(*(F.least(F.greatest((F.col("x")[i] - float(out.mean[i])) / float(out.scale[i]), F.lit(-20.0)), F.lit(20.0)) for i in range(size)))
        given = rows.select(array_to_vector(standard).alias("features"), F.col("y").cast("double").alias("label"), weight.alias("weight"))
        m = LogisticRegression(weightCol="weight", regParam=ridge / total, standardization=False, maxIter=100, tol=1e-9).fit(given)
        out.w = np.r_[m.coefficients.toArray(), m.intercept]
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))


def prior_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a class-balanced sample the classes' shares among all labelled rows."""
    have = np.array([max(1, (y == k).sum()) for k in (0, 1)], float)
    all_ = np.array([counts.get(k, 0) + 1 for k in (0, 1)], float)
    share = all_ / all_.sum() / (have / have.sum())
    return share[y.astype(int)]
