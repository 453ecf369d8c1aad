"""Scores of retrieved rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: accesses at which the signal is full.
ACCESS_CAP = 50


@dataclass(frozen=True)
class RankWeights:
    similarity: float = 0.6
    importance: float = 0.15
    access: float = 0.1
    graph_boost: float = 0.15

    def normalised(self) -> RankWeights:
        """Negative and NaN weights are 0; a sum that isn't positive and finite gives the defaults."""
        w = [x if x > 0 else 0.0 for x in (self.similarity, self.importance, self.access, self.graph_boost)]
        total = sum(w)
        return RankWeights(*(x / total for x in w)) if 0 < total < math.inf else RankWeights()


def unit_similarity(cosine: Column) -> Column:
    """[-1, 1] to [0, 1]; null is 0."""
    return F.when(cosine.isNull() | (cosine <= -1), 0.0).when(cosine >= 1, 1.0).otherwise((cosine + 1) / 2)


def access_signal(count: Column) -> Column:
    return F.sqrt(F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(ACCESS_CAP)) / F.lit(float(ACCESS_CAP)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def components(weights: RankWeights, cosine: Column, importance: Column, access: Column, graph: Column) -> Column:
    w = weights.normalised()
    return F.struct(
        (F.lit(w.similarity) * unit_similarity(cosine)).alias("similarity"),
        (F.lit(w.importance) * clamp01(importance)).alias("importance"),
        (F.lit(w.access) * access_signal(access)).alias("access"),
        (F.lit(w.graph_boost) * F.when(graph, 1.0).otherwise(0.0)).alias("graph_boost"),
    )


def total(parts: Column) -> Column:
    return clamp01(parts["similarity"] + parts["importance"] + parts["access"] + parts["graph_boost"])
