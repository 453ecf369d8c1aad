"""Each registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestore.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        path = f"{SF}/{t}"
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    return None if v is None else f"{v + 0:.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows(found, names, order):
    return sorted(tuple(map(str, (plain(r[names.index(c)]) for c in order))) for r in found)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert found
        return
    want = db.sql(catalogue.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    assert rows(found, df.columns, order) == rows(want.fetchall(), list(want.columns), order)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/documents.parquet")
    from lodestore.operators.filters import MemoryFilter, for_listing
    from lodestore.state import MemoryState

    memory = plan.selectExpr("doc_id AS id", "lang AS source", "'active' AS status", "text AS uuid", "0.5D AS importance", "doc_id AS created_at", "doc_id AS last_accessed", "doc_id AS access_count")
    state = MemoryState(memory, None, None, None, None)
    text = for_listing(state, MemoryFilter(created_after=5)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,5)" in text and "text" not in text.split("ReadSchema")[1]


def test_whole_documents_are_remembered_and_embedded(spark):
    from lodestore.plans import fixtures as fx

    before, after = fx.state(spark, SF), {r.table: r for r in catalogue.QUERIES["remember_batch_state"](spark, SF).collect()}
    fresh = catalogue.QUERIES["dedup_insert"](spark, SF).where("action = 'inserted'").count()
    assert fresh and after["memory"].n == before.memory.count() + fresh
    assert after["embeddings"].n == before.embeddings.count() + fresh and after["memory_tags"].n > before.memory_tags.count()
    assert after["entities"].n > before.entities.count() and after["relations"].n > before.relations.count()
    assert catalogue.QUERIES["mock_embedding_memory"](spark, SF).count() == before.memory.count()


def test_linking_broadcasts_nothing_that_grows_with_texts(spark):
    from lodestore.operators import writes
    from lodestore.plans import fixtures as fx

    texts = spark.createDataFrame([("a", "[[Ada|poet]] met Grace Hopper"), ("b", "Grace Hopper met Ada"), ("c", "")], "uuid string, content string")
    new, entities, relations = writes.link(fx.bare_state(spark), texts, 1)
    found = {r.uuid: (r.name, r.type) for r in new.entities.collect()}
    assert set(found.values()) == {("Ada", "wiki:poet"), ("Grace Hopper", "unknown"), ("Ada", "unknown")} and entities.count() == 3
    edges = {(found[r.source_uuid], found[r.target_uuid]) for r in new.relations.collect()}
    assert edges == {(("Ada", "wiki:poet"), ("Grace Hopper", "unknown")), (("Grace Hopper", "unknown"), ("Ada", "unknown"))} and relations.count() == 2
    plan = catalogue.QUERIES["extract_link_relations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "documents" not in plan


def test_a_name_of_several_kinds_is_linked_by_one(spark):
    from lodestore.functions.extraction import Extractor, hashtags
    from lodestore.operators import writes
    from lodestore.plans import fixtures as fx

    own = Extractor(lambda text: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in (("A", "x"), ("B", "y"), ("A", "unknown"), ("B", "z")))), hashtags)
    new, _, _ = writes.link(fx.bare_state(spark), spark.createDataFrame([("a", "-")], "uuid string, content string"), 1, extractor=own)
    found = {r.uuid: (r.name, r.type) for r in new.entities.collect()}
    assert {(found[r.source_uuid], found[r.target_uuid]) for r in new.relations.collect()} == {(("A", "unknown"), ("B", "y")), (("B", "y"), ("A", "unknown"))}


def test_extract_link_makes_no_table(spark):
    plan = catalogue.QUERIES["extract_link"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "entities-" not in plan


def test_link_min_confidence_makes_no_table(spark):
    plan = catalogue.QUERIES["link_min_confidence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "entities-" not in plan


@pytest.mark.parametrize("limit", [4096, 20])
def test_cosines_of_blocks_against_all_pairs(spark, limit):
    """Vectors of other lengths, zero ones and ones with nulls among them; blocks of any size."""
    from lodestore.operators import retrieval

    rows = [(f"u{i:02}", [float(i % 7) - 3, float(i % 5), float(i % 11)]) for i in range(90)] + [("x", [1.0, 2.0]), ("n", None), ("m", [1.0, None, 2.0]), ("z", [0.0, 0.0, 0.0]), ("e", [])]
    e = spark.createDataFrame(rows, "memory_uuid string, vector array<double>")
    found = retrieval.cosine_pairs(e, e.select(F.col("memory_uuid").alias("query_id"), F.col("vector").alias("query")), rows_limit=limit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.split("CoGroup")[0] and "NestedLoop" not in plan and "Cartesian" not in plan

    def cosine(v, w):
        size = sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5
        return sum(x * y for x, y in zip(v, w)) / size if size else 0.0

    whole = [(u, v) for u, v in rows if v is not None and None not in v]
    want = {(a, b): round(cosine(v, w), 9) for a, v in whole for b, w in whole if len(v) == len(w)}
    got = found.collect()
    assert len(got) == len(want) and {(r.query_id, r.uuid): round(r.cosine, 9) for r in got} == want
    near = retrieval.knn_batch(e, e.select(F.col("memory_uuid").alias("query_id"), F.col("vector").alias("query")), 4, 0.1, rows_limit=limit)
    best = {q: sorted((-c, u) for (a, u), c in want.items() if a == q and c >= 0.1)[:4] for q, _ in whole}
    assert {(r.query_id, r["rank"], r.uuid) for r in near.collect()} == {(q, i + 1, u) for q, b in best.items() for i, (_, u) in enumerate(b)}


def test_knn_of_every_50th_takes_blocks_and_makes_no_other_table(spark):
    plan = catalogue.QUERIES["knn_batch_every_50th"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan and "lambdafunction((lambda x" not in plan


def test_remembering_a_batch_shuffles_no_relation_that_it_cannot_meet(spark):
    from lodestore.operators import writes
    from lodestore.plans import fixtures as fx

    s = fx.state(spark, SF)
    known = s.relations.limit(50).withColumn("predicate", F.when(F.col("confidence") > 0.15, F.col("predicate")))
    texts = spark.createDataFrame([("a", "Ada met Grace Hopper")], "uuid string, content string")
    new, _, made = writes.link(s.with_(relations=known), texts, 1)
    assert made.count() == 1 and new.relations.count() == 51 and {r.uuid for r in known.collect()} < {r.uuid for r in new.relations.collect()}
    again, _, made = writes.link(new, texts, 2)
    assert [r.action for r in made.collect()] == ["unchanged"] and again.relations.count() == 51
    relations = writes.remember(fx.passing_state(spark, SF), fx.batch(spark, SF), 1, None, 64, check=False)[0].relations
    plan = relations.select(F.xxhash64(*relations.columns))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("FullOuter" in line and "source_uuid" in line for line in plan.split("\n")) and "FullOuter" in plan  # of entities only
