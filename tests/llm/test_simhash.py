import random

import numpy as np
import xxhash

from lodestore.llm import components, simhash

DOCS = "doc_id long, text string, print string, _gone string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \t", "one", "one two", "One TWO", "É a b c", "é a b c"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return [*out, "long " * 40000, "x y " * 40000]


def test_near_dedup_against_brute_force(spark):
    data = [(i * 3 + 1, t, "p", "b") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, DOCS).repartition(3)
    found = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    prints = [brute_print(t) for _, t, *_ in data]
    roots = brute_roots(prints)
    assert len(found) == len(data)
    for (i, *_), p, r in zip(data, prints, roots):
        assert found[i].fingerprint == f"{p:016x}" and found[i].component_id == data[r][0]
    kept = simhash.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({data[r][0] for r in roots})
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_dedup(empty).count() == 0 and simhash.kept_rows(empty).count() == 0


def planted(n=3000):
    rng = random.Random(5)
    codes = {rng.getrandbits(64) for _ in range(n // 2)}
    centre = rng.getrandbits(64)
    while len(codes) < n:  # chains, and a dense cloud
        base = centre if rng.random() < 0.3 else rng.choice(tuple(codes))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            base ^= 1 << b
        codes.add(base)
    return sorted(codes)


def test_index_finds_every_link():
    codes = np.array(planted(1500), dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(codes))
    codes = codes[order]
    index = simhash.GrayIndex(codes, np.zeros(len(codes), dtype=np.int64))
    found = {(int(a), int(b)) for x, y in index.links() for a, b in zip(x, y)}
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 3)) if a < b}
    assert found == want and len(want) > 1000


def test_split_buckets_lose_nothing(spark, monkeypatch):
    codes = planted(800)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    prints = spark.createDataFrame([(c,) for c in signed], "print long")
    edges = simhash.buckets_of(prints).repartition(4, "bucket").sortWithinPartitions("bucket").mapInArrow(simhash._link, "src long, dst long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_roots(codes)
    groups, found = {}, {}
    for c, s, w in zip(codes, signed, want):
        groups.setdefault(w, set()).add(s)
        found.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(500)] + [(7, 7)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert roots == {i: 0 for i in range(201)} | {1000: 1000} | {2000 + i: 1000 for i in range(500)}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_with_heavy_centres(spark, monkeypatch):
    from lodestore.llm import components as module

    monkeypatch.setattr(module, "HEAVY_AT", 5)
    monkeypatch.setattr(module, "HEAVY_PARTS", 10)
    edges = [(1000, i) for i in range(200)] + [(2000 + i, 5000) for i in range(300)] + [(5000, 7000), (7000, 7001)]
    found = dict(map(tuple, module.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert found == {**{i: 0 for i in range(200)}, 1000: 0, **{2000 + i: 2000 for i in range(300)}, 5000: 2000, 7000: 2000, 7001: 2000}
