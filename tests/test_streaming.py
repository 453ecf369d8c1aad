import json

import pytest

from lodestore.functions.vectors import mock_embedding
from lodestore.sources.store import Store
from lodestore.streaming import jobs

SCHEMA = "uuid string, content string, source string, importance double, tags array<string>"


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "store"))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def row(i, content):
    return {"uuid": f"u{i}", "content": content, "source": "agent", "importance": 0.2, "tags": ["s"]}


def test_remember_stream_and_lifecycle(spark, store, tmp_path):
    source = tmp_path / "in"
    put(source, "a.json", [row(0, "first note"), row(1, "second note"), row(2, "first note")])
    stream = spark.readStream.schema(SCHEMA).json(str(source))
    stats = jobs.JobStats()
    jobs.remember_stream(store, stream, lambda: 1000, str(tmp_path / "ck"), lambda c: mock_embedding(c, 8), 8, stats).awaitTermination(120)
    put(source, "b.json", [row(3, "second note"), row(4, "third note")])
    jobs.remember_stream(store, stream, lambda: 2000, str(tmp_path / "ck"), lambda c: mock_embedding(c, 8), 8, stats).awaitTermination(120)
    assert (stats.remembered, stats.duplicates) == (3, 2)
    state = store.load()
    assert state.memory.count() == 3 and state.embeddings.count() == 3

    now = [10**7]
    life = jobs.Lifecycle(store, lambda: now[0], gc_every=600, stale_after=5000, importance_at_most=0.3)
    assert (life.tick().collected, life.tick().ticks) == (3, 2)
    assert store.load().memory.where("status = 'archived'").count() == 3
    before = store.snapshot()
    now[0] += 700
    life.tick()
    assert store.snapshot() == before  # nothing to do, nothing written


def test_lifecycle_on_a_trigger(spark, store):
    life = jobs.Lifecycle(store, lambda: 5)
    query = life.start(spark, "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert life.stats.ticks >= 1


def test_access_counts(spark, tmp_path):
    source = tmp_path / "ev"
    put(source, "a.json", [{"memory_uuid": "a", "ts": "2024-01-01T00:10:00Z"}, {"memory_uuid": "a", "ts": "2024-01-01T00:20:00Z"}, {"memory_uuid": "b", "ts": "2024-01-01T01:20:00Z"}])
    stream = spark.readStream.schema("memory_uuid string, ts timestamp").json(str(source))
    query = jobs.access_counts(stream).writeStream.outputMode("complete").format("memory").queryName("acc").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.memory_uuid, r.n) for r in spark.table("acc").collect()} == {("a", 2), ("b", 1)}
