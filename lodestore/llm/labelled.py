"""Labelled rows for training, and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. Null id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    """_id and _label of the ids to learn from: not held out, and with one label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL").where(~held_out(F.col("_id")))
    return rows.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")


def all_training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """y and text of every labelled document that isn't held out. Ids with both labels are left out; of
    rows that repeat an id the least text counts. Texts move only where an id repeats, or where the
    labels are too many for a broadcast."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = written(_known(labels, label).join(rows.groupBy("_id").agg(F.count("*").alias("_n")), "_id"), "labelled")
    n, repeated = known.agg(F.count("*"), F.count_if(F.col("_n") > 1)).first()
    found = rows.join(small(known, n, 64), "_id")
    once = found.where("_n = 1").select(F.col("_label").alias("y"), "text")
    if not repeated:
        return once
    return once.unionByName(found.where("_n > 1").groupBy("_id").agg(F.min("_label").alias("y"), F.min("text").alias("text")).drop("_id"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[list[str]], list[int]]:
    """Texts of class 0 and of class 1, at most `most` of each (the lowest hashes of their ids), none
    of them held out; and how many rows each class has in all. Ids with both labels are left out; of
    rows that repeat an id the least text counts."""
    rows = _known(labels, label)
    counts = dict(rows.groupBy("_label").count().collect())
    order = [F.xxhash64("_id"), F.col("_id")]
    some = rows.where("_label = 0").orderBy(*order).limit(most).unionByName(rows.where("_label = 1").orderBy(*order).limit(most))
    texts: list[list[str]] = [[], []]
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(some), "_id")  # at most 2 * most rows
    found = found.groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"), F.min("_label").alias("_label"))
    for _, text, y in sorted(map(tuple, found.collect()), key=lambda r: r[0]):
        texts[y].append(text)
    return texts, [counts.get(0, 0), counts.get(1, 0)]


class Logistic:
    """Weighted logistic regression of a few standardised features, by Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self._design(x)

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z @ w))
            return (z * (weight * p * (1 - p))[:, None]).T @ z, z.T @ (weight * (y - p))

        self._fit(sums, ridge)

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], ridge: float = 1.0) -> Logistic:
        """The same from a table of features, y and n, how many rows are so. Each step is an aggregation;
        sums are of decimals, so that no order of rows changes them."""
        self, k = cls.__new__(cls), len(features)

        def totals(*terms: Column) -> np.ndarray:
            found = rows.agg(*[F.sum((F.col("n") * t).cast("decimal(38,18)")).alias(f"_{i}") for i, t in enumerate(terms)]).first()
            return np.array([float(v) for v in found])

        x = [F.col(c) for c in features]
        n, *first = totals(F.lit(1.0), *x)
        self.mean = np.array(first) / n
        self.scale = np.maximum(np.sqrt(totals(*[(c - F.lit(m)) ** 2 for c, m in zip(x, self.mean.tolist())]) / n), 1e-9)
        z = [F.lit(1.0), *[(c - F.lit(m)) / F.lit(s) for c, m, s in zip(x, self.mean.tolist(), self.scale.tolist())]]
        upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = z[0] * F.lit(float(w[0]))
            for c, v in zip(z[1:], w[1:].tolist()):
                at = at + c * F.lit(v)
            p = 1 / (1 + F.exp(-at))
            found = totals(*[p * (1 - p) * z[i] * z[j] for i, j in upper], *[(F.col("y") - p) * c for c in z])
            h = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(upper, found):
                h[i, j] = h[j, i] = v
            return h, found[len(upper) :]

        self._fit(sums, ridge)
        return self

    def _fit(self, sums, ridge: float) -> None:
        """sums: of weights, the second derivative's and the gradient's sums over all rows."""
        self.w = np.zeros(len(self.mean) + 1)
        keep = np.full(len(self.w), ridge)
        keep[0] = 1e-3
        for _ in range(50):
            h, gradient = sums(self.w)
            step = np.linalg.solve(h + np.diag(keep), gradient - keep * self.w)
            self.w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))


class Constant:
    """Where a class has no rows to learn from."""

    def __init__(self, p: float):
        self.p = p

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def class_weights(y: np.ndarray, totals: list[int]) -> np.ndarray:
    """So that the sample counts as the classes do in all labelled rows."""
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    return np.where(y == 1, totals[1] / n[1], totals[0] / n[0]) * len(y) / max(1, sum(totals))
