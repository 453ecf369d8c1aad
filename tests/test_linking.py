"""Linking of long texts: pairs made in cells, names of any length, and what a remembered batch moves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestore.functions import extraction, vectors
from lodestore.operators import cooccurrence, writes
from lodestore.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def before_each_other(lists):
    return {(a, b) for ids in lists for i, a in enumerate(ids) for b in ids[i + 1 :] if a != b}


@pytest.mark.parametrize("blocks", [2, 5])
def test_pairs_of_cells_against_all_pairs(spark, blocks):
    rng = random.Random(7)
    lists = [[rng.randrange(-40, 40) for _ in range(n)] for n in (0, 1, 2, 3, 30, 30, 60)]
    rows = spark.createDataFrame([(ids,) for ids in [*lists, None]], "ids array<long>").repartition(3)
    names = spark.range(-40, 40).select("id", F.col("id").cast("string").alias("uuid"))
    found = [(int(r.source_uuid), int(r.target_uuid)) for r in cooccurrence.ordered_pairs(rows, names, blocks).collect()]
    assert len(found) == len(set(found)) and set(found) == before_each_other(lists)


def test_a_cell_of_many_pairs_is_made_in_parts(monkeypatch):
    monkeypatch.setattr(cooccurrence, "PAIRS", 3)
    monkeypatch.setattr(cooccurrence, "ROWS", 2)
    lists = [[0, 2, 4, 6, 1, 3], [6, 4, 2, 0], [1, 0], [3, 3]]
    schema = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("uuid", pa.string()), ("ids", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary())])
    held = [{"cell": 0, "id": i, "uuid": str(i)} for i in range(7)]
    held.append({"cell": 0, "ids": np.arange(7, dtype="<i8").tobytes(), "places": np.array(sum(lists, []), "<u4").tobytes(), "sizes": np.array([*map(len, lists)], "<u4").tobytes()})
    batch = pa.RecordBatch.from_pylist(held, schema)
    for cell, want in ((0, lambda a, b: a % 2 == b % 2), (1, lambda a, b: a % 2 != b % 2)):
        grid = [(0, 0), (0, 1)]
        found = [(int(a), int(b)) for part in cooccurrence._pairs([batch], cell, grid, 2) for a, b in zip(*(c.to_pylist() for c in part.columns))]
        every = before_each_other(lists)
        assert len(found) == len(set(found)) and set(found) == (every if not cell else {p for p in every if want(*p)})


def test_a_run_of_any_number_of_capitalised_words_is_a_name(spark):
    long = " ".join(["Abc"] * 50_000)
    rows = spark.createDataFrame([(f"{long} and Ada. B",)], "t string").select(extraction.entities(F.col("t")).alias("e"))
    assert [e.name for e in rows.first().e] == [long, "Ada. B"]


def test_a_name_with_blanks_around_it_meets_its_id(spark):
    texts = spark.createDataFrame([("a", "[[ Ada]] met Grace Hopper")], "uuid string, content string")
    for in_cells in (False, True):
        new, _, made = writes.link(fx.bare_state(spark), texts, 1, in_cells=in_cells)
        names = {r.uuid: r.name for r in new.entities.collect()}
        assert [(names[r.source_uuid], names[r.target_uuid]) for r in made.collect()] == [("Ada", "Grace Hopper")]


def test_a_remembered_batch_shuffles_no_pair_and_stores_fresh_texts_only(spark):
    new, _ = writes.remember(fx.passing_state(spark, SF), fx.batch(spark, SF), 1, vectors.mock_embedding, 64)
    plan = new.relations.select(F.xxhash64(*new.relations.columns))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any("Exchange" in line and "source_uuid" in line for line in plan.split("\n"))
    read = new.memory.inputFiles()
    assert any("/fresh-" in f for f in read) and not any("conversations" in f for f in read)
