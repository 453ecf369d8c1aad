"""Settings of an engine and its jobs: defaults, then a TOML file, then environment variables
LODESTORE_<SECTION>__<KEY>, each over what came before. Unknown names and wrong types are errors."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import SparkSession

from ..engine import MemoryEngine
from ..errors import ValidationError
from ..functions.extraction import NOTHING, RULES
from ..streaming.jobs import Lifecycle
from .embedding import EmbeddingRegistry, default_registry

PREFIX = "LODESTORE_"


@dataclass(frozen=True)
class StoreSettings:
    root: str = "lodestore-data"


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str = "mock"
    dims: int = 64


@dataclass(frozen=True)
class GraphSettings:
    auto_extract: bool = True


@dataclass(frozen=True)
class ForgettingSettings:
    enabled: bool = True
    stale_after: int = 90 * 86400
    importance_at_most: float = 0.3
    action: str = "archive"
    check_every: int = 600


@dataclass(frozen=True)
class JobSettings:
    ttl_every: int = 60


@dataclass(frozen=True)
class Settings:
    store: StoreSettings = field(default_factory=StoreSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    graph: GraphSettings = field(default_factory=GraphSettings)
    forgetting: ForgettingSettings = field(default_factory=ForgettingSettings)
    jobs: JobSettings = field(default_factory=JobSettings)

    def merged(self, given: Mapping[str, Mapping]) -> Settings:
        out = self
        for section, values in given.items():
            if section not in {f.name for f in fields(self)} or not isinstance(values, Mapping):
                raise ValidationError(f"unknown section {section!r}")
            now = getattr(out, section)
            out = replace(out, **{section: replace(now, **{k: _typed(now, section, k, v) for k, v in values.items()})})
        return out

    def checked(self) -> Settings:
        if not self.store.root.strip():
            raise ValidationError("store.root must not be empty")
        if self.embedding.dims <= 0 or self.jobs.ttl_every <= 0 or self.forgetting.check_every <= 0 or self.forgetting.stale_after < 0:
            raise ValidationError("dims and intervals must be positive")
        if not 0 <= self.forgetting.importance_at_most <= 1:
            raise ValidationError("forgetting.importance_at_most must be in [0, 1]")
        if self.forgetting.action not in ("archive", "delete"):
            raise ValidationError(f"unknown action {self.forgetting.action!r}")
        return self

    def save(self, path: str) -> None:
        """As TOML; load() reads it back. JSON's strings, numbers and booleans are TOML's too."""
        lines = [line for section, values in asdict(self).items() for line in (f"[{section}]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in values.items()), "")]
        with open(path, "w", encoding="utf-8") as out:
            out.write("\n".join(lines))

    def engine(self, spark: SparkSession, registry: EmbeddingRegistry | None = None, **more) -> MemoryEngine:
        provider = (registry or default_registry(self.embedding.dims)).get(self.embedding.provider)
        return MemoryEngine(spark, self.store.root, provider, extractor=RULES if self.graph.auto_extract else NOTHING, **more)

    def lifecycle(self, engine: MemoryEngine, clock: Callable[[], int] | None = None) -> Lifecycle:
        f = self.forgetting
        return Lifecycle(engine.store, clock or engine.clock, f.check_every, f.enabled, f.action, stale_after=f.stale_after, importance_at_most=f.importance_at_most)


def _typed(now, section: str, key: str, value):
    """The value as its default's type; texts are read as TOML reads them, for variables."""
    if key not in {f.name for f in fields(now)}:
        raise ValidationError(f"unknown setting {section}.{key}")
    kind = type(getattr(now, key))
    if isinstance(value, str) and kind is not str:
        try:
            value = tomllib.loads(f"v = {value}")["v"]
        except tomllib.TOMLDecodeError as e:
            raise ValidationError(f"{section}.{key}: {value!r} isn't a value") from e
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind:
        raise ValidationError(f"{section}.{key} must be {kind.__name__}")
    return value


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """path, or else what LODESTORE_CONFIG names, if anything."""
    environ = os.environ if environ is None else environ
    settings = Settings()
    if path := path or environ.get(f"{PREFIX}CONFIG"):
        with open(path, "rb") as f:
            try:
                given = tomllib.load(f)
            except tomllib.TOMLDecodeError as e:
                raise ValidationError(f"{path}: {e}") from e
        settings = settings.merged(given)
    for name, value in sorted(environ.items()):
        section, _, key = name.removeprefix(PREFIX).lower().partition("__")
        if name.startswith(PREFIX) and key:
            settings = settings.merged({section: {key: value}})
    return settings.checked()
