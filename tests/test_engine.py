import math
import random

import pytest
from pyspark.sql import functions as F

from lodestore.engine import MemoryEngine
from lodestore.errors import ConflictError, EmbeddingError, NotFoundError, ValidationError
from lodestore.functions import ranking, vectors
from lodestore.operators import catalog, forget, graph, recall, retrieval, writes
from lodestore.operators.filters import MemoryFilter
from lodestore.operators.recall import HybridWeights, RecallOptions
from lodestore.sources import embedding
from lodestore.sources.store import Store

DAY = 86400


@pytest.fixture
def engine(spark, tmp_path):
    clock = {"now": 1_700_000_000}

    def now():
        clock["now"] += 1
        return clock["now"]

    made = MemoryEngine(spark, str(tmp_path / "store"), clock=now)
    made.at = clock
    return made


def test_remember_twice_merges_tags(engine):
    a = engine.remember("hello world", tags=["a", " b "], importance=0.8)
    b = engine.remember("  hello world ", tags=["b", "c"], importance=0.1)
    assert not a["duplicate"] and b["duplicate"] and a["uuid"] == b["uuid"] and not b["embedding_stored"]
    row = engine.get(a["uuid"])
    assert row["tags"] == ["a", "b", "c"] and row["importance"] == 0.8
    assert engine.stats()["total"] == 1 and engine.stats()["vectors"] == 1
    with pytest.raises(NotFoundError):
        engine.get("nobody")


@pytest.mark.parametrize("content,importance", [("  ", 0.5), ("x", -0.1), ("x", 1.5), ("x", math.nan), ("x", math.inf)])
def test_remember_rejects(engine, content, importance):
    with pytest.raises(ValidationError):
        engine.remember(content, importance=importance)


def test_deleted_rows_can_be_inserted_again_archived_not(engine):
    a = engine.remember("one")["uuid"]
    engine.forget(a, mode="archive")
    again = engine.remember("one")
    assert again["duplicate"] and again["uuid"] == a and engine.get(a)["status"] == "archived"
    engine.forget(a, mode="soft")
    assert not engine.remember("one")["duplicate"]


def test_hard_forget_cascades(engine):
    a = engine.remember("alpha", tags=["t"])["uuid"]
    x, y = engine.upsert_entity("X")["uuid"], engine.upsert_entity("Y")["uuid"]
    engine.upsert_relation(x, y, "knows", memory_uuid=a)
    engine.delete_memory(a)
    state = engine.state
    assert state.memory.count() == state.embeddings.count() == state.memory_tags.count() == 0
    assert state.relations.first()["memory_uuid"] is None
    with pytest.raises(NotFoundError):
        engine.forget(a)


def test_forget_by_filter_takes_the_newest(engine):
    ids = [engine.remember(f"row {i}", importance=0.1, embed=False, extract_graph=False)["uuid"] for i in range(5)]
    assert engine.forget(f=MemoryFilter(importance_max=0.2, access_count_lt=2), mode="archive", batch_limit=3) == 3
    assert [engine.get(u)["status"] for u in ids] == ["active"] * 2 + ["archived"] * 3
    s = engine.stats()
    assert (s["active"], s["archived"]) == (2, 3)
    with pytest.raises(ValidationError):
        engine.forget(f=MemoryFilter(), batch_limit=0)
    with pytest.raises(ValidationError):
        engine.list(MemoryFilter(status_in=[]))
    with pytest.raises(ValidationError):
        engine.list(MemoryFilter(status_in=["gone"]))


def test_recall_modes_feedback_and_filter(engine):
    a = engine.remember("banana smoothie bowl", tags=["z"])["uuid"]
    b = engine.remember("banana bread", source="user", importance=0.95)["uuid"]
    c = engine.remember("rust code")["uuid"]
    assert {r.uuid for r in engine.recall("banana", RecallOptions(mode="keyword")).collect()} == {a, b}
    assert {r.uuid for r in engine.recall("banana", RecallOptions(mode="hybrid"), feedback=False).collect()} >= {a, b}
    assert {r.uuid for r in engine.recall("anything", RecallOptions(mode="semantic"), feedback=False).collect()} == {a, b, c}
    assert [engine.get(u)["access_count"] for u in (a, b, c)] == [1, 1, 0]
    one = RecallOptions(mode="keyword", filter=MemoryFilter(tags_any=["z"]))
    assert [r.uuid for r in engine.recall("banana", one, feedback=False).collect()] == [a]
    many = RecallOptions(mode="keyword", filter=MemoryFilter(importance_min=0.9, source_in=["user"]))
    assert [r.uuid for r in engine.recall("banana", many, feedback=False).collect()] == [b]
    engine.forget(a)
    assert [r.uuid for r in engine.recall("banana", RecallOptions(mode="keyword"), feedback=False).collect()] == [b]
    assert a in {r.uuid for r in engine.recall("banana", RecallOptions(mode="semantic", status_scope="unfiltered"), feedback=False).collect()}
    for bad in (RecallOptions(mode="psychic"), RecallOptions(top_k=0), RecallOptions(top_k=201)):
        with pytest.raises(ValidationError):
            engine.recall("x", bad)
    assert engine.recall("x", RecallOptions(hybrid=HybridWeights(0, 0, 0)), feedback=False).count() == 0


def test_graph_recall_pulls_in_related_rows(engine):
    m1, m2 = engine.remember("alice note")["uuid"], engine.remember("unrelated text")["uuid"]
    a, b = engine.upsert_entity("Alice", "person")["uuid"], engine.upsert_entity("Bob", "person")["uuid"]
    engine.upsert_relation(a, b, "knows", 0.9, m1)
    engine.upsert_relation(b, a, "likes", 0.9, m2)
    hits = engine.recall("alice", RecallOptions(mode="hybrid", hybrid=HybridWeights(0.4, 0.4, 0.2), graph_depth=2), feedback=False).collect()
    assert {r.uuid for r in hits} == {m1, m2} and any(r.from_graph for r in hits)
    keyword = engine.recall("alice", RecallOptions(mode="keyword", graph_depth=2), feedback=False).collect()
    assert [r.uuid for r in keyword] == [m1]


def test_extract_and_link(engine):
    text = "#todo [[Alice Smith]] had a meeting with [[Bob Jones]] at [[Acme Corp]]."
    made = engine.extract_and_link(text)
    assert made["entities_upserted"] >= 3 and made["relations_created"] >= 3
    assert engine.extract_and_link(text) == {"entities_upserted": 0, "relations_created": 0}
    assert engine.extract_and_link(text, enabled=False) == {"entities_upserted": 0, "relations_created": 0}
    assert engine.extract_and_link("Zed met Yan", min_confidence=0.9)["relations_created"] == 0


def test_remember_extracts(engine):
    out = engine.remember("#docs [[Trae]] told Alice Smith to deploy Kubernetes.", tags=["v1"])
    assert out["tags"] == ["v1", "docs"]
    assert engine.state.entities.count() >= 3 and engine.state.relations.count() >= 1
    assert engine.state.relations.where("memory_uuid IS NOT NULL").count() == 0


def test_entities_and_relations(engine):
    first = engine.upsert_entity("Alice", "person", "first", '{"a":1}')
    again = engine.upsert_entity(" Alice ", "person")
    assert (first["action"], again["action"]) == ("created", "updated") and first["uuid"] == again["uuid"]
    row = catalog.entity(engine.state, first["uuid"]).first()
    assert row["description"] == "first" and row["metadata_json"] == '{"a":1}'
    engine.upsert_entity("Alex", "person")
    bob = engine.upsert_entity("Bob", "org")["uuid"]
    assert catalog.list_entities(engine.state, "al").count() == 2 and catalog.list_entities(engine.state, kind="org").count() == 1
    r = engine.upsert_relation(first["uuid"], bob, "knows", 0.4)
    up = engine.upsert_relation(first["uuid"], bob, "knows", 0.9, metadata_json='{"since":2024}')
    same = engine.upsert_relation(first["uuid"], bob, "knows", 0.5)
    assert [x["action"] for x in (r, up, same)] == ["inserted", "updated", "unchanged"] and len({x["uuid"] for x in (r, up, same)}) == 1
    kept = catalog.relation(engine.state, r["uuid"]).first()
    assert kept["confidence"] == 0.9 and kept["metadata_json"] == '{"since":2024}'
    for args in ((bob, bob, "x"), ("none", bob, "x"), (bob, "none", "x"), (bob, first["uuid"], " ")):
        with pytest.raises(ValidationError):
            engine.upsert_relation(*args)
    with pytest.raises(ValidationError):
        engine.upsert_entity(" ")
    gone = forget.delete_entities(engine.state, catalog.entity(engine.state, bob))
    assert gone.relations.count() == 0 and gone.entities.count() == 2


def relations(spark, edges):
    rows = [(f"e{i:03d}", a, b, "p", 1.0, None, "{}", 0) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "uuid string, source_uuid string, target_uuid string, predicate string, confidence double, memory_uuid string, metadata_json string, created_at long")


def fifo(edges, start, depth_cap, node_cap):
    out, queue = [(start, 0, [start])], [(start, 0, [start])]
    seen = {start}
    while queue and len(out) < node_cap:
        node, depth, path = queue.pop(0)
        if depth == depth_cap:
            continue
        for v in [b for a, b in edges if a == node] + [a for a, b in edges if b == node]:
            if v not in seen and len(out) < node_cap:
                seen.add(v)
                out.append((v, depth + 1, [*path, v]))
                queue.append(out[-1])
    return out


@pytest.mark.parametrize("nodes", [200, 7])
def test_traversal_is_in_order_of_discovery(spark, nodes):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)]
    edges = [(a, b) for a, b in dict.fromkeys(edges) if a != b]
    found = graph.traverse(relations(spark, edges), "n0", 3, nodes).orderBy("position").collect()
    assert [(r.uuid, r.depth, r.path) for r in found] == fifo(edges, "n0", 3, nodes)
    depths = {r.uuid: r.depth for r in graph.bfs_depth(relations(spark, edges), spark.createDataFrame([("n0",)], "uuid string"), 3).collect()}
    assert depths == {u: d for u, d, _ in fifo(edges, "n0", 3, 10**6)}


def test_tags(engine):
    u = engine.remember("x", tags=["a", "b"], extract_graph=False)["uuid"]
    rows = lambda *t: engine.spark.createDataFrame([(u, list(t))], "memory_uuid string, tags array<string>")
    s = engine.state
    tags = lambda s: [r.tag for r in catalog.tags_of_memory(s, u).collect()]
    assert tags(writes.detach_tags(s, rows(" a "))) == ["b"]
    assert tags(writes.replace_tags(s, rows(" c ", "d"))) == ["c", "d"]
    assert tags(writes.attach_tags(s, rows("", " ", "b", "e"))) == ["a", "b", "e"]


def test_updates(engine):
    u = engine.remember("x")["uuid"]
    new = forget.update(engine.state, u, importance=0.99, metadata_json='{"k":"v"}')
    row = catalog.get_memory(new, u).first()
    assert row["importance"] == 0.99 and row["metadata_json"] == '{"k":"v"}'
    with pytest.raises(ValidationError):
        forget.update(new, u, importance=2)
    with pytest.raises(NotFoundError):
        forget.update(new, "nobody", importance=0.5)
    assert catalog.list_memories(new, MemoryFilter(metadata_match={"k": "v"})).count() == 1


def test_expiry_and_staleness(spark, engine):
    for i, days in enumerate((1, 2, None)):
        engine.remember(f"t{i}", expires_at=None if days is None else engine.at["now"] + days * DAY, embed=False, extract_graph=False)
    s = forget.expire(engine.state, engine.at["now"] + 3 * DAY)
    assert s.memory.where("status = 'expired'").count() == 2
    s = forget.expire(s, engine.at["now"] + 4 * DAY)
    assert s.memory.where("status = 'expired'").count() == 2
    late = engine.at["now"] + 100 * DAY
    assert forget.collect_stale(s, late, enabled=False) is s
    assert forget.collect_stale(s, late).memory.where("status = 'archived'").count() == 0  # importance 0.5
    assert forget.collect_stale(s, late, importance_at_most=0.5).memory.where("status = 'archived'").count() == 1
    assert forget.collect_stale(s, late, "delete", importance_at_most=0.5).memory.count() == 2


def test_vectors_by_threshold(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [-1.0, 0.0, 0.0]), ("c", [0.7, 0.7, 0.0]), ("z", [0.0, 0.0, 0.0]), ("o", [1.0])]
    e = spark.createDataFrame(rows, "memory_uuid string, vector array<double>")
    got = lambda t: [(r.uuid, round(r.cosine, 3)) for r in retrieval.knn(e, [1.0, 0.0, 0.0], 10, t).collect()]
    assert got(-2) == [("a", 1.0), ("c", 0.707), ("z", 0.0), ("b", -1.0)]
    assert got(0.5) == [("a", 1.0), ("c", 0.707)] and got(0.9) == [("a", 1.0)]
    for bad in ([], [math.nan], [math.inf]):
        with pytest.raises(ValidationError):
            retrieval.knn(e, bad)
    unit = spark.createDataFrame([(str(i), [math.cos(i), math.sin(i)]) for i in range(40)], "memory_uuid string, vector array<double>")
    exact = [r.uuid for r in retrieval.knn(unit, [0.8, 0.6], 4).collect()]
    near = retrieval.knn_ann(unit, [0.8, 0.6], 4).collect()
    assert [r.uuid for r in sorted(near, key=lambda r: -r.cosine)] == exact


def test_scalars(spark):
    row = spark.sql("SELECT 1")
    unit = [row.select(ranking.unit_similarity(F.lit(x).cast("double"))).first()[0] for x in (1.0, -1.0, 0.0, None, 1.5, -2.0)]
    assert unit == [1, 0, 0.5, 0, 1, 0]
    signal = [row.select(ranking.access_signal(F.lit(n))).first()[0] for n in (0, 5, 50, 5000)]
    assert signal[0] == 0 and 0 < signal[1] < 1 and signal[2:] == [1, 1]
    w = ranking.RankWeights(6, 1.5, 1, 1.5).normalised()
    assert (w.similarity, w.importance, w.access, w.graph_boost) == pytest.approx((0.6, 0.15, 0.1, 0.15))
    assert ranking.RankWeights(-1, math.nan, 0, 0).normalised() == ranking.RankWeights()
    assert row.select(vectors.l2_to_cosine(F.lit(0.0))).first()[0] == 1


def test_rrf(spark):
    def arms(*lists):
        rows = [(u, i + 1, f"s{k}", float(w)) for k, (w, items) in enumerate(lists) for i, u in enumerate(items)]
        return spark.createDataFrame(rows, "uuid string, rank int, label string, weight double")

    found = retrieval.rrf(arms((1, "ab"), (1, "ac"))).orderBy(F.desc("rrf"), "uuid").collect()
    assert [r.uuid for r in found] == ["a", "b", "c"] and found[0].labels == ["s0", "s1"]
    assert found[0].rrf == pytest.approx(1 / 26)
    equal = retrieval.rrf(arms((0, "a"), (0, "b"))).collect()
    assert len({r.rrf for r in equal}) == 1
    assert {r.rrf for r in retrieval.rrf(arms((1, "a")), 0).collect()} == {0.5}


def test_ranker_orders(spark):
    rows = [(1.0, None, True, 0), (0.0, -0.6, False, 0)]
    df = spark.createDataFrame(rows, "importance double, cosine double, from_graph boolean, access_count int")
    scores = [r.score for r in retrieval.rank_linear(df).collect()]
    assert scores[0] > scores[1]
    assert retrieval.rank_linear(df, threshold=2.0).where("score < 1").count() == 0


def test_embedding_providers(spark):
    df = spark.createDataFrame([("hello world",), ("hello world",), ("hello galaxy",)], "t string")
    mock = embedding.MockProvider(16)
    a, b, c = (r[0] for r in df.select(mock.column(F.col("t"))).collect())
    assert a == b != c and len(a) == 16 and all(-1 <= x <= 1 for x in a)

    def fnv(text, i):
        h = 0xCBF29CE484222325 ^ i
        h = (h * 0x100000001B3) % 2**64
        for byte in text.encode():
            h = ((h ^ byte) * 0x100000001B3) % 2**64
        return (h & 0xFFFFFFFF) / 2**31 - 1

    assert a == pytest.approx([fnv("hello world", i) for i in range(16)])
    odd = spark.createDataFrame([("",), (None,), ("naïve 日本 🙂",), ("x" * 5000,)], "t string").select("t", vectors.mock_embedding(F.col("t"), 8).alias("a"), vectors.mock_expression(F.col("t"), 8).alias("b"))
    assert all(r.a is None and r.t is None or r.a == r.b for r in odd.collect())
    assert df.select(embedding.ZeroProvider(4).column(F.col("t"))).first()[0] == [0.0] * 4
    remote = embedding.RemoteProvider(embedding.EmbeddingMeta("r", "m", 2), lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert [r[0] for r in df.select(remote.column(F.col("t"))).collect()] == [[11.0, 1.0], [11.0, 1.0], [12.0, 1.0]]
    short = embedding.RemoteProvider(embedding.EmbeddingMeta("r", "m", 3), lambda: lambda texts: [[1.0]] * len(texts))
    with pytest.raises(Exception, match="another shape"):
        df.select(short.column(F.col("t"))).collect()
    registry = embedding.default_registry()
    assert registry.names() == ["mock", "zero"]
    with pytest.raises(ValidationError):
        registry.get("none")


def test_retries():
    waits, calls = [], []

    def call(status, until):
        calls.append(1)
        if len(calls) <= until:
            raise embedding.ServiceError(status)
        return ["done"]

    assert embedding.retried(lambda: call(429, 2), sleep=waits.append) == ["done"]
    assert len(waits) == 2 and all(0.2 <= w <= 2 for w in waits)
    calls.clear()
    with pytest.raises(EmbeddingError):
        embedding.retried(lambda: call(400, 9), sleep=waits.append)
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(EmbeddingError):
        embedding.retried(lambda: call(503, 9), sleep=waits.append)
    assert len(calls) == 4


def test_store_snapshots(spark, tmp_path, engine):
    first = engine.store.snapshot()
    engine.remember("kept")
    assert engine.store.snapshot() != first and Store.open(spark, engine.store.root).load().memory.count() == 1
    engine.remember("more")
    before = engine.store.size_on_disk()
    assert engine.store.vacuum(keep=1) >= 1 and len(engine.store._commits()) == 1 and engine.store.size_on_disk() < before
    assert engine.state.memory.count() == 2


def test_batch_recall_is_one_plan(spark, engine):
    engine.remember("a b c")
    plan = recall.recall(engine.state, "a", engine.embed("a"), RecallOptions())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "TakeOrderedAndProject" in plan


def test_knn_batch_goes_through_more_queries_than_the_limit(spark):
    from lodestore.operators import retrieval

    rows = [(f"u{i}", [float(i % 7) + 1, float(i % 5), float(i)]) for i in range(60)]
    e = spark.createDataFrame(rows, "memory_uuid string, vector array<double>")
    q = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "query_id long, query array<double>")
    want = {tuple(r) for r in retrieval.knn_batch(e, q, 3).collect()}
    got = retrieval.knn_batch(e, q, 3, rows_limit=20).collect()
    assert len(got) == 180 and {tuple(r) for r in got} == want


def test_a_commit_writes_changed_tables_only(spark, engine):
    engine.remember("counted words")
    before = engine.state.origin
    assert engine.recall("counted", RecallOptions(mode="keyword")).count() == 1
    after = engine.state.origin
    assert after.number == before.number + 1 and {t for t in after.places if after.places[t] != before.places[t]} == {"memory"}
    assert engine.state.memory.first().access_count == 1


def test_the_second_writer_gets_a_conflict(spark, engine):
    engine.remember("one")
    a, b = engine.state, engine.state
    engine.store.commit(a.with_(memory=a.memory.withColumn("importance", F.lit(0.1))))
    with pytest.raises(ConflictError):
        engine.store.commit(b.with_(memory=b.memory.withColumn("importance", F.lit(0.2))))
    assert engine.state.memory.first().importance == 0.1
    made = []

    def change(state):
        if not made:  # another writer comes between
            other = engine.state
            engine.store.commit(other.with_(memory=other.memory.withColumn("access_count", F.lit(7))))
        made.append(1)
        return state.with_(memory=state.memory.withColumn("importance", F.lit(0.3))), "done"

    assert engine._change(change) == "done" and len(made) == 2
    row = engine.state.memory.first()
    assert (row.access_count, row.importance) == (7, 0.3)


def test_a_store_of_the_first_version_is_brought_up_to_date(spark, tmp_path, engine):
    import json

    engine.remember("old words here")
    state, root = engine.state, tmp_path / "old"
    for t in ("memory", "embeddings", "entities", "relations", "memory_tags"):
        getattr(state, t).write.parquet(f"{root}/v=1/{t}")
    (root / "CURRENT").write_text(json.dumps({"snapshot": "v=1", "schema_version": 1}))
    new = MemoryEngine(spark, str(root))
    assert new.recall("old", RecallOptions(mode="keyword")).count() == 1 and new.state.postings.where("term = 'words'").count() == 1


@pytest.mark.parametrize("query", ["alpha", "alp be", '"beta gamma"', '"beta gam"*', "alpha OR delta", "alpha NOT beta", '(alpha OR "gamma delta") AND eps', "a-b", "nothing", '"beta beta"'])
def test_the_index_gives_what_a_scan_gives(spark, query):
    rng, words = random.Random(5), ["alpha", "alphabet", "beta", "gamma", "delta", "epsilon", "a", "b", "Be-ta"]
    rows = [(i, f"u{i}", rng.choice(["active", "archived"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    memory = spark.createDataFrame(rows, "id long, uuid string, status string, content string")
    want = [tuple(r) for r in retrieval.bm25(memory, query, 50).collect()]
    got = retrieval.bm25(memory, query, 50, index=retrieval.keyword_index(memory))
    assert [(r.uuid, r.id, round(r.bm25, 9), round(r.score, 9)) for r in got.collect()] == [(u, i, round(b, 9), round(s, 9)) for u, i, b, s in want]


def test_the_index_is_kept_and_reads_its_terms_only(spark, engine):
    for text in ("pineapple smoothie", "banana smoothie bowl", "unrelated words"):
        engine.remember(text)
    assert engine.recall("smoothie", RecallOptions(mode="keyword")).count() == 2
    gone = engine.state.memory.where("content LIKE 'pine%'").first()
    engine.forget(gone.uuid, mode="hard")
    assert engine.state.postings.where("term = 'pineapple'").count() == 0
    state = engine.state
    want = sorted(map(str, retrieval.keyword_index(state.memory).collect()))
    assert sorted(map(str, state.postings.collect())) == want
    plan = retrieval.bm25(state.memory, "smoothie", index=state.postings)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,smoothie)" in plan and "content" not in plan


def test_rejections_name_every_broken_rule(spark, engine):
    rows = spark.createDataFrame([(0, "x", "text", "nobody", 2.0, [], "[1]")], "seq long, uuid string, content string, source string, importance double, tags array<string>, metadata_json string")
    with pytest.raises(ValidationError, match="importance.*source.*JSON"):
        writes.insert(engine.state, rows, 1)
    found = engine.remember("Ada Byron met Grace Hopper")
    assert found["entities_extracted"] == 2 and found["relations_extracted"] == 1


def test_vector_blobs(spark):
    import struct

    rows = spark.createDataFrame([(1, struct.pack("<3f", 1.0, -2.5, 0.0)), (2, b""), (3, None)], "i int, blob binary")
    found = rows.select("i", vectors.from_blob(F.col("blob")).alias("v"))
    assert sorted(map(tuple, found.collect())) == [(1, [1.0, -2.5, 0.0]), (2, []), (3, None)]
    back = found.select("i", vectors.to_blob(F.col("v")).alias("blob"))
    assert sorted((r.i, r.blob and bytes(r.blob)) for r in back.collect()) == sorted((r.i, r.blob and bytes(r.blob)) for r in rows.collect())
    with pytest.raises(Exception, match="whole floats"):
        spark.createDataFrame([(b"abc",)], "blob binary").select(vectors.from_blob(F.col("blob"))).collect()


def test_an_extractor_of_ones_own_and_none(spark, tmp_path):
    from lodestore.functions import extraction

    nothing = MemoryEngine(spark, str(tmp_path / "none"), extractor=extraction.NOTHING)
    out = nothing.remember("#docs [[Ada]] met Grace Hopper", tags=["t"])
    assert (out["entities_extracted"], out["tags"]) == (0, ["t"]) and nothing.state.entities.count() == 0
    upper = extraction.Extractor(lambda text: F.array(F.struct(F.upper(text).alias("name"), F.lit("whole").alias("type"))), extraction.hashtags)
    own = MemoryEngine(spark, str(tmp_path / "own"), extractor=upper)
    assert own.extract_and_link("abc") == {"entities_upserted": 1, "relations_created": 0}
    assert own.state.entities.first().name == "ABC"


def test_deleting_one_by_one(engine):
    a = engine.remember("Ada met Grace Hopper", extract_graph=False)["uuid"]
    x, y = engine.upsert_entity("X")["uuid"], engine.upsert_entity("Y")["uuid"]
    r = engine.upsert_relation(x, y, "knows", 0.5, memory_uuid=a)["uuid"]
    engine.delete_vector(a)
    engine.delete_vector(a)
    engine.delete_vector("nobody")
    stats = engine.stats()
    assert (stats["vectors"], stats["total"], stats["relations"]) == (0, 1, 1) and stats["uptime"] > 0
    engine.delete_relation(r)
    for call in (lambda: engine.delete_relation(r), lambda: engine.delete_entity("nobody"), lambda: engine.update_memory("nobody", 0.5)):
        with pytest.raises(NotFoundError):
            call()
    engine.upsert_relation(y, x, "knows")
    engine.delete_entity(x)
    engine.update_memory(a, 0.25, '{"k": 1}')
    assert engine.stats()["entities"] == 1 and engine.stats()["relations"] == 0
    assert engine.get(a)["importance"] == 0.25 and engine.get(a)["metadata_json"] == '{"k": 1}'
    config = {c.key: c.value_json for c in engine.store.system_config().collect()}
    assert config["schema_version"] == "2" and int(config["created_at"]) > 1_600_000_000


def test_typed_rows(spark):
    rows = spark.createDataFrame([(1, 86_400, None, '{"k": {"n": 2}}'), (2, 0, 3, "no json"), (3, 0, 3, None)], "id long, created_at long, last_accessed long, metadata_json string")
    out = catalog.typed(rows)
    assert dict(out.dtypes) == {"id": "bigint", "created_at": "timestamp", "last_accessed": "timestamp", "metadata": "variant"}
    got = out.orderBy("id").select(F.unix_timestamp("created_at"), F.unix_timestamp("last_accessed"), F.try_variant_get("metadata", "$.k.n", "int"), F.col("metadata").isNull()).collect()
    assert [tuple(r) for r in got] == [(86_400, None, 2, False), (0, 3, None, True), (0, 3, None, True)]


def test_rowids_of_uuids(spark):
    import struct
    import uuid

    ids = [str(uuid.UUID(int=i)) for i in (0, 1 << 64, (1 << 128) - 1, 0x8000000000000000 << 64, 0x00000000000000FF << 64)] + [str(uuid.uuid4()) for _ in range(50)]
    given = spark.createDataFrame([(u,) for u in ids + [ids[7].replace("-", "").upper(), "nothing", "", None]], "u string")
    got = [r[0] for r in given.select(vectors.uuid_rowid(F.col("u"))).collect()]
    want = [struct.unpack("<q", uuid.UUID(u).bytes[:8])[0] for u in ids]
    assert got == [*want, want[7], None, None, None]


def test_settings(spark, tmp_path):
    from lodestore.sources import config

    assert config.load(environ={}) == config.Settings()
    path = str(tmp_path / "a.toml")
    (tmp_path / "a.toml").write_text('[store]\nroot = "x"\n[embedding]\ndims = 8\n[forgetting]\nimportance_at_most = 1\n')
    made = config.load(path, {"LODESTORE_EMBEDDING__DIMS": "16", "LODESTORE_GRAPH__AUTO_EXTRACT": "false", "LODESTORE_STORE__ROOT": str(tmp_path / 'a "store"'), "OTHER__KEY": "1"})
    assert made.embedding.dims == 16 and made.forgetting.importance_at_most == 1.0 and not made.graph.auto_extract
    made.save(str(tmp_path / "b.toml"))
    assert config.load(environ={"LODESTORE_CONFIG": str(tmp_path / "b.toml")}) == made
    engine = made.engine(spark)
    assert engine.provider.meta.dims == 16 and engine.remember("#tag [[Ada]]")["entities_extracted"] == 0
    assert made.lifecycle(engine).tick().ticks == 1
    wrong = [{"nothing": {"a": 1}}, {"store": {"a": 1}}, {"store": 1}, {"embedding": {"dims": "x y"}}, {"embedding": {"dims": True}}, {"store": {"root": 1}}]
    for given in wrong:
        with pytest.raises(ValidationError):
            config.Settings().merged(given)
    for given in ({"embedding": {"dims": 0}}, {"store": {"root": " "}}, {"forgetting": {"action": "burn"}}, {"forgetting": {"importance_at_most": 2.0}}):
        with pytest.raises(ValidationError):
            config.Settings().merged(given).checked()
    (tmp_path / "c.toml").write_text("[store\n")
    with pytest.raises(ValidationError):
        config.load(str(tmp_path / "c.toml"), {})
