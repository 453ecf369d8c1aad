import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestore.llm import packing, token_store
from lodestore.llm.tokens import Encoder, tokenizer_path
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, length string, row string, offset string"
ODD = ["", None, "a", " a", "a ", "  ", "a  b", "a \n b", "a\n\nb", "x <|endoftext|> y", "don't we'll  ", "naïve  words  end", "日本 語 テキスト", "a\t b \tc", "🙂 🙂", "word " * 9000]


@pytest.fixture(scope="module")
def encode():
    return Encoder(tokenizer_path(), cache_words=50)


def plain(text):
    """The call that the contract names, with a tokenizer of its own."""
    if "t" not in ENCODER:
        ENCODER["t"] = Tokenizer.from_file(tokenizer_path())
    return np.array(ENCODER["t"].encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_strings_of_special_tokens(encode):
    text = "x<|endoftext|>y and more <|endoftext|>"
    assert encode.encode([text]) == [plain(text)] and 50256 in np.frombuffer(plain(text), "<u2")
    ordinary = Encoder(tokenizer_path(), ordinary=True)
    assert 50256 not in np.frombuffer(ordinary.encode([text])[0], "<u2")
    assert ordinary.tokenizer.decode(np.frombuffer(ordinary.encode([text])[0], "<u2").tolist()) == text


def test_encoder_equals_whole_texts(encode):
    import random

    rng = random.Random(1)
    made = " ".join("".join(rng.choice("abcdeéßñçÄïąжи日ªʰ'") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", ".", "?", "!!", "1"]) for _ in range(3000))
    assert encode.encode([made]) == [plain(made)]
    for _ in range(2):  # with an empty and with a full cache
        assert encode.encode(ODD) == [plain(t or "") for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sĠé1., \x1f<|>", max_size=30), max_size=4))
def test_encoder_on_any_text(texts):
    e = ENCODER.setdefault(0, Encoder(tokenizer_path(), cache_words=20))
    assert e.encode(texts) == [plain(t) for t in texts]


ENCODER: dict = {}


def rows():
    return [(i * 7 % 101, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3000, "twice", "", "", ""), (3000, "a first", "", "", "")]


def text_hash(spark, text):
    """Spark's hash of a text; a null leaves the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_store_round_trip(spark, encode):
    data = rows()
    folder, keys = token_store.write_store(spark.createDataFrame(data, DOCS).repartition(3), end_id=2, shards=3)
    found = sorted(token_store.read_store(spark, folder, keys).collect(), key=lambda r: r.start)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(spark, r[1])))
    assert [r.doc_id for r in found] == [r[0] for r in order]
    start = 0
    for r, (_, text, *_) in zip(found, order):
        ids = np.append(encode.whole(text or "").astype("<u4"), np.uint32(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        got = token_store.ids_of(folder, r.doc_id, r.occurrence)
        assert got.tolist() == ids.tolist()
        start += len(ids)
    assert token_store.ids_of(folder, 123456) is None
    strangers = spark.createDataFrame([(10**9 + i, 0) for i in range(500)], "doc_id long, occurrence long")
    assert token_store.read_store(spark, folder, strangers).count() == 0


def test_hot_ids_and_texts_are_dealt_out(spark, encode):
    """An id with many texts, one row many times over, null ids, and many empty texts."""
    data = [(5, f"text {i % 40}") for i in range(400)] + [(7, "the same row")] * 500 + [(None, f"n {i % 3}") for i in range(100)] + [(100 + i, "") for i in range(1000)] + [(1, "first"), (6, "between")]
    folder, keys = token_store.write_store(spark.createDataFrame(data, "doc_id long, text string").repartition(5), end_id=2, shards=8)
    assert keys.where("doc_id = 7").select("shard").distinct().count() > 1 and keys.where("doc_id = 5").select("shard").distinct().count() > 1
    assert keys.count() == keys.select("doc_id", "occurrence").distinct().count() == len(data)
    found = sorted(token_store.read_store(spark, folder, keys).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.occurrence) for r in found] == sorted(((r.doc_id, r.occurrence) for r in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, texts = 0, sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(spark, r[1])))
    for r, (doc, text) in zip(found, texts, strict=True):
        ids = np.append(np.frombuffer(plain(text), "<u2"), 2).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.ids_of(folder, 7, 499).tolist() == [*np.frombuffer(plain("the same row"), "<u2").tolist(), 2]
    assert token_store.ids_of(folder, 7, 500) is None


def test_a_look_up_reads_little(spark):
    folder, _ = token_store.write_store(spark.range(20000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), shards=2)

    class Counted:
        def __init__(self, f):
            self.f, self.read = f, 0

        def read_at(self, n, at):
            self.read += n
            return self.f.read_at(n, at)

    fs, name = token_store._fs(f"{folder}/index-000000.mph")
    with fs.open_input_file(name) as f:
        keys = token_store.key_hash(np.arange(20000), np.zeros(20000, np.int64))
        whole = token_store.Index(token_store.get(f"{folder}/index-000000.mph")).find(keys)[0]
        for i in range(0, 20000, 997):
            counted = Counted(f)
            assert token_store.find_one(counted, int(keys[i])) == whole[i]
            assert counted.read < 2000


def test_long_documents_are_read_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([3, 900, 1, 0, 2000, 5])], "doc_id long, text string")
    folder, keys = token_store.write_store(docs, shards=1)
    want = sorted(map(tuple, token_store.read_store(spark, folder, keys).collect()), key=str)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(keys.orderBy("offset").toPandas(), preserve_index=False)
    monkeypatch.setattr(token_store, "READ_BYTES", 400)
    got = [r for b in token_store._read(folder, 2)(iter([batch])) for r in b.to_pylist()]
    assert sorted(((r["doc_id"], r["occurrence"], r["offset"], r["length"], r["ids_crc32"]) for r in got), key=str) == want


def test_store_of_nothing(spark):
    folder, keys = token_store.write_store(spark.createDataFrame([], DOCS))
    assert token_store.read_store(spark, folder, keys).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20000])
def test_perfect_hash(n):
    keys = token_store.key_hash(np.arange(n) * 13 - 5, np.zeros(n, dtype=np.int64))
    made = token_store.PerfectHash.build(keys)
    assert sorted(made.slot(keys).tolist()) == list(range(n))


def check_packed(found, encode, texts, size, end):
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in found:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.append(encode.whole(text or "").astype("<u4"), np.uint32(end)).astype("<u4")
        at = 0
        for k in range(len(pieces[doc])):
            r = pieces[doc][k]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == size or k == 0
            at += r.length
        assert at == len(ids) and len(pieces[doc]) == -(-len(ids) // size)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_pack(spark, encode, monkeypatch):
    texts = {i: f"some words {i} " * (1 + i * 37 % 300) for i in range(600)} | {1000 + i: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in texts.items()], DOCS).repartition(3)
    found = packing.pack(docs).collect()
    n = check_packed(found, encode, texts, 2048, 0)
    assert n <= 1.01 * sum(r.length for r in found) / 2048 + 2
    monkeypatch.setattr(packing, "PART_ROWS", 20)  # many parts, and levels
    found = packing.pack(docs).collect()
    assert check_packed(found, encode, texts, 2048, 0) <= n + 2
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_the_rule_by_brute_force():
    rng, size = np.random.default_rng(1), 20
    lengths = rng.integers(1, 21, 200)
    bins, fill = packing.pack_lengths(lengths, size), []
    for n, b in zip(lengths.tolist(), bins.tolist()):

        def square(gaps):
            return sum(c * c for c in np.bincount([g for g in gaps if 0 < g < size], minlength=size))

        gaps = [size - f for f in fill]
        after = {g: square([*gaps[: gaps.index(g)], g - n, *gaps[gaps.index(g) + 1 :]]) for g in set(gaps) if g >= n}
        after[size] = square([*gaps, size - n])
        chosen = gaps[b] if b < len(fill) else size
        assert after[chosen] == min(after.values())
        fill.append(0) if b == len(fill) else None
        fill[b] += n
    assert max(fill) <= size
