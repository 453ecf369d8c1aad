"""Embedding providers: expressions that stay in the JVM, and remote services in Arrow batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..errors import EmbeddingError, ValidationError
from ..functions.vectors import mock_embedding


@dataclass(frozen=True)
class EmbeddingMeta:
    provider: str
    model: str
    dims: int


class EmbeddingProvider(Protocol):
    meta: EmbeddingMeta

    def column(self, text: Column) -> Column: ...


class MockProvider:
    """Deterministic, without a model."""

    def __init__(self, dims: int = 64):
        self.meta = EmbeddingMeta("mock", "fnv1a", dims)

    def column(self, text: Column) -> Column:
        return mock_embedding(text, self.meta.dims)


class ZeroProvider:
    def __init__(self, dims: int = 64):
        self.meta = EmbeddingMeta("zero", "zero", dims)

    def column(self, text: Column) -> Column:
        return F.array_repeat(F.lit(0.0), self.meta.dims)


#: Statuses of a service that are worth another try.
RETRY_STATUSES = frozenset({429, *range(500, 600)})


class ServiceError(EmbeddingError):
    def __init__(self, status: int):
        super().__init__(f"service answered {status}")
        self.status = status


def retried(call: Callable[[], list], attempts: int = 4, base: float = 0.2, cap: float = 2.0, sleep=time.sleep, rng=random) -> list:
    """Decorrelated jitter: each wait is uniform between base and three times the last, at most cap."""
    wait = base
    for attempt in range(attempts):
        try:
            return call()
        except ServiceError as e:
            if e.status not in RETRY_STATUSES or attempt == attempts - 1:
                raise
        wait = min(cap, rng.uniform(base, 3 * wait))
        sleep(wait)
    raise AssertionError("unreachable")


class RemoteProvider:
    """A client (list of texts -> list of vectors; raises ServiceError) called on executors, batch by
    batch; answers are checked for number and length. client_factory is called once a task."""

    def __init__(self, meta: EmbeddingMeta, client_factory: Callable[[], Callable[[list[str]], list]], batch: int = 64):
        self.meta, self.client_factory, self.batch = meta, client_factory, batch

    def column(self, text: Column) -> Column:
        if (spark := SparkSession.getActiveSession()) is not None:
            ship(spark)
        factory, size, dims = self.client_factory, self.batch, self.meta.dims

        @F.pandas_udf("array<double>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = factory()
            for part in parts:
                out: list = []
                for at in range(0, len(part), size):
                    texts = part.iloc[at : at + size].tolist()
                    found = retried(lambda texts=texts: client(texts))
                    if len(found) != len(texts) or any(len(v) != dims for v in found):
                        raise EmbeddingError("the service's answer has another shape")
                    out += found
                yield pd.Series(out)

        return embed(text)


class EmbeddingRegistry:
    def __init__(self):
        self._providers: dict[str, EmbeddingProvider] = {}

    def insert(self, name: str, provider: EmbeddingProvider) -> None:
        self._providers[name] = provider

    def get(self, name: str) -> EmbeddingProvider:
        if name not in self._providers:
            raise ValidationError(f"no provider {name!r}")
        return self._providers[name]

    def names(self) -> list[str]:
        return sorted(self._providers)


def default_registry(dims: int = 64) -> EmbeddingRegistry:
    registry = EmbeddingRegistry()
    registry.insert("mock", MockProvider(dims))
    registry.insert("zero", ZeroProvider(dims))
    return registry
