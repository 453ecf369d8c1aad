"""The pipeline's stages, each on its own input, against brute force; and the queries' SQL."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lodestore.llm import queries, toxicity
from lodestore.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def lower(t):
    return (t or "").encode().lower()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_in_order(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    first = stages["toxicity"][0].columns
    assert all(after.columns == first for name, (_, after) in stages.items() if name != "packing")


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    data = rows(before)
    keep = model.score([r["text"] for r in data]) < 0.5
    assert Counter(r["doc_id"] for r in rows(after)) == Counter(r["doc_id"] for r, k in zip(data, keep) if k)


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in rows(before):
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(best.values())


def test_near_stage(stages):
    from test_simhash import brute_print, brute_roots

    before, after = stages["near_dedup"]
    data = sorted(rows(before), key=lambda r: r["doc_id"])
    roots = brute_roots([brute_print(r["text"]) for r in data])
    assert sorted(r["doc_id"] for r in rows(after)) == sorted({data[i]["doc_id"] for i in roots})


def test_mixing_stage(stages):
    from test_exact_and_shards import brute_targets

    before, after = stages["mixing"]
    sizes, texts, got = Counter(), {}, Counter()
    for r in rows(before):
        sizes[r["source"]] += len(lower(r["text"]).split())
        texts[r["doc_id"]] = r["text"]
    copies = defaultdict(list)
    for r in rows(after):
        got[r["source"]] += len(lower(r["text"]).split())
        assert texts[r["doc_id"]].startswith(r["text"])
        copies[r["doc_id"]].append(r["text"])
    goal = brute_targets(dict(sizes))
    assert all(abs(got[s] - goal[s]) <= max(1, 0.002 * goal[s]) for s in sizes)
    assert all(len(c) <= 2 for c in copies.values())


def test_packing_stage(stages):
    before, after = stages["packing"]
    encode = Encoder(tokenizer_path())
    want = Counter()
    for r in rows(before):
        ids = np.append(encode.whole(r["text"] or "").astype("<u4"), np.uint32(0)).astype("<u4")
        first = (len(ids) - 1) % 2048 + 1
        for piece, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : first if not piece else at + 2048]
            want[(r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    found = rows(after)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(places) <= sum(r["length"] for r in found) / 2048 * 1.01 + 2


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, rows(corpus_pipeline.run(spark, SF)))) == sorted(map(key, rows(stages["packing"][1])))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_queries_equal_their_sql(spark, name, sf):
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    want = db.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf)
    order = list(want.columns)
    plain = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, found.select(*order).collect())) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_give_a_row_for_each_input_row(spark, name):
    found = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'embeddings' if 'embedding' in name else 'documents'}.parquet").count()
    assert found.count() >= n if "packing" in name else found.count() == n


def test_near_and_mixing_stages_take_rows_of_null_and_repeated_ids(spark):
    from lodestore.llm import mixing, simhash

    long = " ".join(f"word{i}" for i in range(300))
    schema = "doc_id long, text string, source string"
    docs = [(1, long, "a"), (None, long, "a"), (None, "unique words of a null id", "a"), (1, long, "b"), (2, "one text of id two", "a"), (2, "quite another text here", "a"), (2, long, "a")]
    kept = simhash.kept_rows(spark.createDataFrame(docs, schema).repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, long), (None, docs[2][1]), (2, docs[4][1]), (2, docs[5][1])])
    # one id and source, five sizes: each row has its own passes and cut
    docs = [(i, " ".join(f"{s}{k}" for k in range(n)), s) for s in "ab" for i in (None, 7) for n in (1, 10, 100, 1000, 5000)]
    df = spark.createDataFrame(docs, schema)
    got = sum(len(r.text.split()) for r in mixing.mixed_rows(df).collect())
    assert got == sum(r.taken for r in mixing.mix(df).collect())
    assert got == sum(r.taken for r in mixing.mix(df.repartition(5)).collect())


def test_python_workers_keep_little_between_stages(monkeypatch):
    """Idle workers stay beside an executor's JVM: at a task's end each stage gives memory back, and of the
    words of toxicity's passes none are kept, only the bounded stretches and costs."""
    import pickle

    import pyarrow as pa

    from lodestore.llm import packing, simhash
    from lodestore.llm.tokens import tokenizer_path

    given = []
    for module in (toxicity, packing, simhash):
        monkeypatch.setattr(module, "release", lambda name=module.__name__.rsplit(".")[-1]: given.append(name))
    monkeypatch.setattr(toxicity, "_caches", {})
    texts = [f"some l1ttle w0rd{i}x betterr{i} {i}" for i in range(3000)]
    reader = pickle.loads(pickle.dumps(toxicity.Reader(toxicity.CharacterModel(Counter({"some": 4, "little": 3})))))
    made = list(toxicity._prepare([pa.record_batch({"y": [i % 2 for i in range(3000)], "text": texts})]))
    rows = [r for b in made for r in b.to_pylist() if r["y"] is not None]
    table = pa.RecordBatch.from_pylist([{k: r[k] for k in ("y", "copy", "words", "spelt")} for r in rows])
    found = list(toxicity._summarise([table], reader, ({"little$": 1.0}, {"some$": 2.0})))
    assert sum(r["n"] for b in found for r in b.to_pylist()) == 3000
    list(simhash._fingerprints([pa.record_batch({"doc_id": [1], "text": [b"a b c d"]})]))
    list(packing._pieces(tokenizer_path(), 2048, 0)([pa.record_batch({"doc_id": [1], "text": ["a b"], "row": [0]})]))
    assert given == ["toxicity", "toxicity", "simhash", "packing"]
    assert {name for _, name in toxicity._caches} == {"costs", "stretches"}
    assert all(len(c) <= toxicity.CACHE_READ < 50_000 for c in toxicity._caches.values())
