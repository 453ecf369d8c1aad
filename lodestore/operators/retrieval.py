"""The retrieval arms: nearest vectors, keywords, and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import ranking, text, vectors
from .cut import cut

K_CAP = 500
#: Vectors in a block of a grid, and the most tasks that its blocks are dealt to.
GRID_ROWS, GRID_TASKS = 1024, 2000
#: BM25's parameters, and what an inverse document frequency that isn't positive becomes.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def knn(embeddings: DataFrame, query: list[float], k: int = 20, threshold: float = -1.0) -> DataFrame:
    """(uuid, cosine) of the k nearest vectors of the query's length, highest first."""
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        raise ValidationError("the query vector must be finite and not empty")
    rows = embeddings.where(F.size("vector") == len(query))
    scored = rows.select(F.col("memory_uuid").alias("uuid"), vectors.cosine_to(vectors.doubles(F.col("vector")), query).alias("cosine"))
    return scored.where(F.col("cosine") >= threshold).orderBy(F.desc(F.round("cosine", 9)), "uuid").limit(min(k, K_CAP))


def _whole(vector: Column) -> Column:
    """Whether it can be compared: neither null nor with null components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def _grid(embeddings: DataFrame, queries: DataFrame, compare, schema: str, rows_limit: int) -> DataFrame:
    """compare(rows (uuid, v), queries (query_id, q)) of blocks of both, as Arrow tables: each block of up
    to about rows_limit queries meets each block of some GRID_ROWS vectors, in a task's numpy. Vectors
    that can't be compared are left out."""
    rows = embeddings.select(F.col("memory_uuid").alias("uuid"), vectors.doubles(F.col("vector")).alias("v")).where(_whole(F.col("v")))
    queries = queries.select("query_id", vectors.doubles(F.col("query")).alias("q")).where(_whole(F.col("q")))
    down = max(1, -(-embeddings.count() // GRID_ROWS))
    across = 1 if (n := queries.count()) <= rows_limit else -(-2 * n // rows_limit)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("_r", F.pmod(F.xxhash64("uuid", "v"), F.lit(down)).cast("int")).withColumn("_q", to(across))
    queries = queries.withColumn("_q", F.pmod(F.xxhash64("query_id", "q"), F.lit(across)).cast("int")).withColumn("_r", to(down))
    tasks = min(down * across, GRID_TASKS)  # given, as sizes don't show the work
    sides = [side.repartition(tasks, "_r", "_q").groupBy("_r", "_q") for side in (rows, queries)]
    return sides[0].cogroup(sides[1]).applyInArrow(compare, schema)


def _by_size(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the places of the vectors, and the vectors."""
    lists = lists.combine_chunks()
    ends = np.cumsum(sizes := pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    values, out = lists.flatten().to_numpy(zero_copy_only=False), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, values[(ends[at] - size)[:, None] + np.arange(size)].reshape(len(at), size)
    return out


def knn_batch(embeddings: DataFrame, queries: DataFrame, k: int = 10, threshold: float = -1.0, rows_limit: int = 4096) -> DataFrame:
    """(query_id, uuid, cosine, rank) for many queries (query_id, query). Blocks of queries meet blocks of
    vectors (_grid); each pair of blocks keeps a query's k best before the rest is shuffled."""

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        of, at, cosine, order = [], [], [], []
        uuids, theirs = np.array(rows["uuid"].to_pylist(), dtype=object), _by_size(rows["v"])
        for size, (asked, q) in _by_size(queries["q"]).items():
            if size not in theirs:
                continue
            places, v = theirs[size]
            found = vectors.cosines(q, v)
            rounded = np.round(found, 9)
            for i, one in enumerate(asked.tolist()):
                near = np.flatnonzero(found[i] >= threshold)
                if len(near) > k:
                    near = near[rounded[i, near] >= np.partition(rounded[i, near], -k)[-k]]
                near = sorted(near.tolist(), key=lambda j: (-rounded[i, j], uuids[places[j]]))[:k]
                of += [one] * len(near)
                at += places[near].tolist()
                cosine += found[i, near].tolist()
                order += rounded[i, near].tolist()
        of, at = pa.array(of, pa.int64()), pa.array(at, pa.int64())
        return pa.table({"query_id": queries["query_id"].take(of), "uuid": rows["uuid"].take(at), "cosine": pa.array(cosine, pa.float64()), "rounded": pa.array(order, pa.float64())})

    few = _grid(embeddings, queries, best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, uuid string, cosine double, rounded double", rows_limit)
    by = W.partitionBy("query_id").orderBy(F.desc("rounded"), "uuid")
    return few.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "uuid", "cosine", "rank")


def cosine_pairs(embeddings: DataFrame, queries: DataFrame, rows_limit: int = 512) -> DataFrame:
    """(query_id, uuid, cosine) of every vector and every query (query_id, query); those of other lengths
    or with null components have no cosine and no row."""

    def pairs(rows: pa.Table, queries: pa.Table) -> pa.Table:
        theirs, parts = _by_size(rows["v"]), []
        for size, (asked, q) in _by_size(queries["q"]).items():
            if size in theirs:
                places, v = theirs[size]
                parts.append((np.tile(asked, len(places)), np.repeat(places, len(asked)), vectors.cosines(v, q).ravel()))
        of, at, cosine = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype) for i, dtype in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query_id": queries["query_id"].take(pa.array(of)), "uuid": rows["uuid"].take(pa.array(at)), "cosine": pa.array(cosine)})

    return _grid(embeddings, queries, pairs, f"query_id {queries.schema['query_id'].dataType.simpleString()}, uuid string, cosine double", rows_limit)


def knn_ann(embeddings: DataFrame, query: list[float], k: int = 10, tables: int = 16, bucket: float = 0.5, seed: int = 7) -> DataFrame:
    """Like knn(), over the vectors that share a bucket of a random projection with the query; then
    ranked exactly. May miss some; for tables too large to scan."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(vectors.dot(v, v)))
    rows = embeddings.where((F.size("vector") == len(query)) & (vectors.dot(vectors.doubles(F.col("vector")), vectors.doubles(F.col("vector"))) > 0))
    rows = rows.select(F.col("memory_uuid").alias("uuid"), unit(vectors.doubles(F.col("vector"))).alias("v")).withColumn("features", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    norm = sum(x * x for x in query) ** 0.5
    near = model.approxNearestNeighbors(rows, Vectors.dense([x / norm for x in query]), k, distCol="distance")
    return near.select("uuid", vectors.l2_to_cosine(F.col("distance")).alias("cosine"))


def postings(memory: DataFrame) -> DataFrame:
    """(term, memory_id, tf, dl, positions)."""
    docs = memory.select(F.col("id").alias("memory_id"), text.tokens(F.col("content")).alias("t"))
    terms = docs.select("memory_id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    return terms.groupBy("term", "memory_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))


def keyword_index(memory: DataFrame) -> DataFrame:
    """postings() and, under the term '', a row for each memory with its length. Stored sorted by term
    (sorted_index), so that a query reads the row groups of its terms and of the lengths only."""
    lengths = memory.select(F.lit("").alias("term"), F.col("id").alias("memory_id"), F.lit(0).cast("long").alias("tf"), F.size(text.tokens(F.col("content"))).alias("dl"), F.array().cast("array<int>").alias("positions"))
    return lengths.unionByName(postings(memory))


def sorted_index(index: DataFrame) -> DataFrame:
    """In order of terms, whole: a frequent term may fill several files, by memory."""
    return index.repartitionByRange(F.col("term"), F.col("memory_id")).sortWithinPartitions("term", "memory_id")


def _of_phrase(phrase: text.Phrase, i: int) -> Column:
    """Whether a term can be the phrase's word i."""
    prefix = phrase.prefix and i == len(phrase.words) - 1
    return F.col("term").startswith(phrase.words[i]) if prefix else F.col("term") == phrase.words[i]


def _shifted(k: int) -> Column:
    return F.transform("positions", lambda x: x - k)


def _indexed(index: DataFrame, wanted: list[text.Phrase]) -> tuple[DataFrame, DataFrame]:
    """From the stored index: (id, dl, f0, f1, ...) of the memories that have any of the phrases'
    words, and the number of memories and their mean length (one row)."""
    any_, counts = F.lit(False), []
    for i, p in enumerate(wanted):
        for k in range(len(p.words)):
            any_ = any_ | _of_phrase(p, k)
        if len(p.words) < 2:
            found = F.sum(F.when(_of_phrase(p, 0), F.col("tf")).otherwise(0)) if p.words else F.lit(0)
        else:  # where the phrase would start, by each of its words
            starts = [F.flatten(F.collect_list(F.when(_of_phrase(p, k), _shifted(k)))) for k in range(len(p.words))]
            both = starts[0]
            for s in starts[1:]:
                both = F.array_intersect(both, s)
            found = F.size(both)
        counts.append(found.alias(f"f{i}"))
    docs = index.where(F.col("term") != "").where(any_).groupBy(F.col("memory_id").alias("id")).agg(F.first("dl").alias("dl"), *counts)
    return docs, index.where(F.col("term") == "").agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))


def postings_stats(memory: DataFrame) -> DataFrame:
    """Rows, tokens and mean length; rows without tokens count."""
    n = memory.select(F.size(text.tokens(F.col("content"))).alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens"), F.avg("dl").alias("avgdl"))


def _matches(tree, hits: dict):
    if isinstance(tree, text.Phrase):
        return hits[tree] > 0
    left, right = _matches(tree.left, hits), _matches(tree.right, hits)
    return left | right if tree.kind == "OR" else left & (~right if tree.kind == "NOT" else right)


def _positive(tree) -> list:
    """Phrases that score: those that aren't excluded."""
    if isinstance(tree, text.Phrase):
        return [tree]
    return _positive(tree.left) + ([] if tree.kind == "NOT" else _positive(tree.right))


def bm25(memory: DataFrame, query: str, k: int = 20, statuses: list[str] | None = ("active",), strict: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(uuid, id, bm25, score) of the k best matches; bm25 is negative, lower is better; score is 1 for
    the best and 0 for the last of the returned ones. Corpus statistics cover rows of every status.
    With the index (keyword_index of all rows of memory) only its rows of the query's terms are read,
    and no text. Without: one pass over the texts; of each a few numbers are kept."""
    if statuses is not None and not statuses:
        raise ValidationError("statuses must not be empty")
    tree = text.parse_query(query, strict)
    if tree is None:
        return memory.where(F.lit(False)).select("uuid", "id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score"))
    wanted = list(dict.fromkeys(text.phrases(tree)))
    scoring = [p for p in wanted if p in set(_positive(tree))]
    with_phrase = [F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(wanted))]
    if index is None:
        folded = memory.select("uuid", "id", "status", text.folded(F.coalesce("content", F.lit(""))).alias("t"))
        docs = folded.select("uuid", "id", "status", text.length(F.col("t")).alias("dl"), *[text.count(F.col("t"), p).alias(f"f{i}") for i, p in enumerate(wanted)])
        docs = cut(docs)  # a few numbers a row, read for statistics and for scores
        totals = docs.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *with_phrase)
    else:
        docs, lengths = _indexed(index, wanted)
        totals = lengths.crossJoin(F.broadcast(docs.agg(*with_phrase)))  # of one row each
    found = docs.where(_matches(tree, {p: F.col(f"f{i}") for i, p in enumerate(wanted)})).crossJoin(F.broadcast(totals))  # of one row
    if index is not None:
        found = found.join(memory.select("id", "uuid", "status"), "id")
    score = F.lit(0.0)
    for i, p in enumerate(wanted):
        if p in scoring:
            n, f = F.col(f"n{i}"), F.col(f"f{i}").cast("double")
            idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = found.withColumn("bm25", score)
    if statuses is not None:
        found = found.where(F.col("status").isin(list(statuses)))
    top = found.select("uuid", "id", "bm25").orderBy(F.round("bm25", 9), "id").limit(k)
    return normalised(top)


def normalised(top: DataFrame) -> DataFrame:
    """Adds score to the few rows of a result: 1 - (bm25 - least) / range, 1 without a range."""
    ends = top.agg(F.min("bm25").alias("lo"), F.max("bm25").alias("hi"))
    scale = F.when(F.col("hi") - F.col("lo") <= 0, F.lit(1.0)).otherwise(ranking.clamp01(1 - (F.col("bm25") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return top.crossJoin(F.broadcast(ends)).select("uuid", "id", "bm25", scale.alias("score"))


def ranked(rows: DataFrame, label: str, weight: float, *order) -> DataFrame:
    """A result's rows as an arm of the fusion. rows are at most a result's limit."""
    return rows.select("uuid", F.row_number().over(W.orderBy(*order)).alias("rank")).select("uuid", "rank", F.lit(label).alias("label"), F.lit(float(weight)).alias("weight"))


def rrf(arms: DataFrame, k: int | None = 25) -> DataFrame:
    """Reciprocal rank fusion of (uuid, rank, label, weight): (uuid, rrf, labels). Weights of the arms
    that have rows are scaled to 1; if none is positive all arms weigh the same. k=0 counts as 1."""
    k = max(1, 25 if k is None else k)
    arms = arms.withColumn("weight", F.greatest("weight", F.lit(0.0)))
    sums = arms.groupBy("label").agg(F.first("weight").alias("w")).agg(F.sum("w").alias("all"), F.count("*").alias("arms"))
    part = F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(1 / F.col("arms"))
    scored = arms.crossJoin(F.broadcast(sums)).withColumn("part", part).where(F.col("part") > 0)
    return scored.groupBy("uuid").agg(F.sum(F.col("part") / (F.lit(k) + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("label")).alias("labels"))


def rank_linear(candidates: DataFrame, weights: ranking.RankWeights = ranking.RankWeights(), threshold: float = 0.0) -> DataFrame:
    """Adds components and score to candidates (cosine, importance, access_count, from_graph), leaves
    those under the threshold. The order is left to the caller's top-k: final_order()."""
    threshold = min(1.0, max(0.0, threshold))
    parts = ranking.components(weights, F.col("cosine"), F.col("importance"), F.col("access_count"), F.col("from_graph"))
    scored = candidates.withColumn("components", parts)
    return scored.withColumn("score", ranking.total(F.col("components"))).where(F.col("score") >= threshold)


def final_order() -> list:
    return [F.desc(F.round("score", 9)), F.desc("created_at"), F.col("uuid")]
