"""MemoryEngine: the operators with a store, a clock and an embedding provider."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConflictError, NotFoundError, ValidationError
from .functions.extraction import RULES, Extractor
from .operators import catalog, forget, graph, recall, writes
from .operators.cut import cut
from .operators.filters import MemoryFilter
from .operators.recall import RecallOptions
from .sources.embedding import EmbeddingProvider, MockProvider
from .sources.store import Store
from .state import MemoryState


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, provider: EmbeddingProvider | None = None, clock: Callable[[], int] = lambda: int(time.time()), extractor: Extractor = RULES):
        self.extractor = extractor
        self.spark, self.store, self.provider, self.clock = spark, Store.open(spark, root), provider or MockProvider(), clock
        self.began = time.monotonic()

    def _change(self, make: Callable[[MemoryState], tuple], tries: int = 5):
        """Commits make(state)'s first and returns its second; made anew where another writer was first."""
        for left in reversed(range(tries)):
            state, result = make(self.state)
            try:
                self.store.commit(state)
                return result
            except ConflictError:
                if not left:
                    raise

    @property
    def state(self) -> MemoryState:
        return self.store.load()

    def _row(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def remember_batch(self, rows: DataFrame, embed: bool = True, extract_graph: bool = True) -> DataFrame:
        """rows (seq, uuid, content, source, importance, tags); ids must be stable when recomputed."""
        meta = self.provider.meta
        now = self.clock()

        def make(state: MemoryState) -> tuple:
            new, out = writes.remember(state, rows, now, self.provider.column if embed else None, meta.dims, extract_graph, meta.provider, meta.model, extractor=self.extractor)
            return new, cut(out)

        return self._change(make)

    def remember(self, content: str, source: str = "agent", importance: float = 0.5, tags: list[str] | None = None, expires_at: int | None = None, metadata_json: str = "{}", embed: bool = True, extract_graph: bool = True) -> dict:
        schema = "seq long, uuid string, content string, source string, importance double, tags array<string>, expires_at long, metadata_json string"
        if not content.strip():
            raise ValidationError("content must not be empty")
        rows = self._row(schema, 0, str(uuid.uuid4()), content, source, float(importance), tags or [], expires_at, metadata_json)
        return self.remember_batch(rows, embed, extract_graph).first().asDict()

    def embed(self, text: str) -> list[float]:
        return self._row("t string", text).select(self.provider.column(F.col("t"))).first()[0]

    def recall(self, query: str, options: RecallOptions = RecallOptions(), feedback: bool = True) -> DataFrame:
        """The hits, with access counts as they were; feedback then counts them."""
        state = self.state
        vector = self.embed(query) if options.mode != "keyword" else None
        hits = recall.recall(state, query, vector, options)
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # at most top_k rows
        if feedback and not hits.isEmpty():
            now = self.clock()
            self._change(lambda state: (recall.apply_feedback(state, hits.select("uuid"), now), None))
        return hits

    def get(self, uuid: str) -> dict:
        row = catalog.get_memory(self.state, uuid).first()
        if row is None:
            raise NotFoundError(f"no memory {uuid}")
        return row.asDict()

    def list(self, f: MemoryFilter = MemoryFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
        return catalog.list_memories(self.state, f, limit, offset)

    def forget(self, uuid: str | None = None, f: MemoryFilter | None = None, mode: str = "soft", gc_graph: bool = False, batch_limit: int = 500) -> int:
        def make(state: MemoryState) -> tuple:
            if uuid is not None:
                return forget.forget_one(state, uuid, mode, gc_graph), 1
            chosen = forget.targets(state, f or MemoryFilter(), batch_limit)
            return forget.forget(state, chosen, mode, gc_graph), chosen.count()

        return self._change(make)

    def delete_memory(self, uuid: str) -> None:
        self.forget(uuid, mode="hard")

    def delete_entity(self, uuid: str) -> None:
        """Its relations go too."""
        self._change(lambda state: (forget.delete_entity(state, uuid), None))

    def delete_relation(self, uuid: str) -> None:
        self._change(lambda state: (forget.delete_relation(state, uuid), None))

    def delete_vector(self, uuid: str) -> None:
        """The memory's vector; nothing happens if it has none."""
        one = self._row("uuid string", uuid)
        self._change(lambda state: (forget.delete_vectors(state, one), None))

    def update_memory(self, uuid: str, importance: float | None = None, metadata_json: str | None = None) -> None:
        self._change(lambda state: (forget.update(state, uuid, importance, metadata_json), None))

    def upsert_entity(self, name: str, kind: str = "unknown", description: str | None = None, metadata_json: str | None = None) -> dict:
        rows = self._row("seq long, uuid string, name string, type string, description string, metadata_json string", 0, str(uuid.uuid4()), name, kind, description, metadata_json)
        now = self.clock()

        def make(state: MemoryState) -> tuple:
            new, out = writes.upsert_entities(state, rows, now)
            return new, out.first().asDict()

        return self._change(make)

    def upsert_relation(self, source: str, target: str, predicate: str, confidence: float = 1.0, memory_uuid: str | None = None, metadata_json: str = "{}") -> dict:
        schema = "seq long, uuid string, source_uuid string, target_uuid string, predicate string, confidence double, memory_uuid string, metadata_json string"
        rows = self._row(schema, 0, str(uuid.uuid4()), source, target, predicate, float(confidence), memory_uuid, metadata_json)
        now = self.clock()

        def make(state: MemoryState) -> tuple:
            new, out = writes.upsert_relations(state, rows, now)
            return new, out.first().asDict()

        return self._change(make)

    def traverse(self, start: str, max_depth: int = 2, max_nodes: int = 200) -> DataFrame:
        state = self.state
        if not state.entities.where(F.col("uuid") == start).limit(1).count():
            raise NotFoundError(f"no entity {start}")
        return graph.traverse(state.relations, start, max_depth, max_nodes).join(state.entities, "uuid").orderBy("position")

    def extract_and_link(self, text: str, enabled: bool = True, min_confidence: float = 0.0, create_relations: bool = True) -> dict:
        if not enabled or not text.strip():
            return {"entities_upserted": 0, "relations_created": 0}
        now = self.clock()

        def make(state: MemoryState) -> tuple:
            new, entities, relations = writes.link(state, self._row("uuid string, content string", "text", text), now, min_confidence=min_confidence, create_relations=create_relations, extractor=self.extractor)
            return new, {"entities_upserted": entities.where("action = 'created'").count(), "relations_created": relations.where("action <> 'unchanged'").count()}

        return self._change(make)

    def stats(self) -> dict:
        return catalog.stats(self.state).first().asDict() | {"bytes": self.store.size_on_disk(), "uptime": time.monotonic() - self.began}
