"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share SHARE
   times all words; a target stops at MOST times its source's words and the excess is shared
   again by weight, until none is above.
2. Quotas: the mix is cut into equal blocks of words, small enough that the smallest target has
   some BLOCKS of them. Sainte-Lague (highest quotients target/(2q+1)) gives each source an integer
   number of blocks, for every output shard: the method never takes back a block when the house
   grows, so a shard's quotas are the difference of two apportionments.
3. Selection: a source's documents stand in a seeded order (MD5 of seed and id) and form one
   stream of words, cut into blocks. Quotas are filled with the blocks from the stream's start, and
   from its start again after its end: the first shard's quota first, then the next one's. So a
   document is taken whole once, twice or not at all; in each source at most one is cut, at the
   last block's end. `shards` lists how many words of a document go to which shard.

Only the list of sources (name, words) comes to the driver. Positions are sums over blocks of
rows, so one source may hold most of the corpus. Defined results: a null text has size 0 and is
taken 0 times; a source without words has target 0; repeated rows are rows like any other; an
empty table gives an empty result. Same seed, same rows: same result in any partitioning.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks_for, join_in_place, packed_rows, running, small, words_in, written

WEIGHTS, SHARE, MOST, BLOCKS = (5, 2, 1), Fraction(3, 2), 2, 1000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, found = dict(order), {}
    left, open_ = share * sum(size.values()), set(size)
    while open_:
        each = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * each > most * size[s]}
        if not above:
            return found | {s: weight[s] * each for s in open_}
        for s in above:
            found[s] = Fraction(most * size[s])
            left -= found[s]
        open_ -= above
    return found


def sainte_lague(goals: list[Fraction], seats: int) -> list[int]:
    """Seats for each goal, given one by one to the highest goal/(2q+1); ties go to the first.
    The seats that any divisor near the ideal gives come at once, only the last few one by one."""
    import heapq

    total = sum(goals)
    if not total or seats <= 0:
        return [0] * len(goals)
    start = max(0, seats - len(goals))
    quota = [max(0, int(g * start / total + Fraction(1, 2))) for g in goals]
    # these are what the divisor total/start gives, at most seats of them as each rounds up by 1/2 at most
    heap = [(-g / (2 * q + 1), i) for i, (g, q) in enumerate(zip(goals, quota)) if g]
    heapq.heapify(heap)
    for _ in range(seats - sum(quota)):
        _, i = heapq.heappop(heap)
        quota[i] += 1
        heapq.heappush(heap, (-goals[i] / (2 * quota[i] + 1), i))
    return quota


def plan(sizes: list[tuple[str | None, int]], shards: int = 24, blocks: int = BLOCKS) -> tuple[list[dict], int]:
    """For each source: source, source_size, target, quotas (blocks, one for each shard), ends (where
    they end in the source's stream of words), words taken."""
    goal = targets(sizes)
    names = sorted(goal, key=lambda s: (s is None, (s or "").encode()))
    size, goals = dict(sizes), [goal[s] for s in names]
    block = max(1, int(min((g for g in goals if g), default=1) / blocks))
    seats = round(sum(goals) / block)
    upto = [sainte_lague(goals, seats * (k + 1) // shards) for k in range(shards)]
    out = []
    for i, s in enumerate(names):
        quotas = [b[i] - a[i] for a, b in zip([[0] * len(names), *upto[:-1]], upto)]
        ends = [min(b[i] * block, MOST * size[s]) for b in upto]  # of the stream's words, where each shard's blocks end
        out.append({"source": s, "source_size": size[s], "target": float(goal[s]), "quotas": quotas, "ends": ends, "words": ends[-1]})
    return out, block


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 24) -> DataFrame:
    """doc_id, size, source_size, target, taken, source; shards: (shard, words) of each shard that takes
    some of its words, and first_shard and last_shard, those of its first and last taken word (null
    if none is)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size"))
    return _mix(rows, seed, shards)


def _mix(rows: DataFrame, seed: int, shards: int, *keys: str) -> DataFrame:
    """mix() of rows (doc_id, source, size, keys); the keys order rows of one id, and come along."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "counted")
    summed = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    planned, _ = plan([(r["source"], r["size"]) for r in summed], shards)
    given = spark.createDataFrame([(p["source"], p["source_size"], p["target"], p["words"], p["ends"]) for p in planned], "_source string, source_size long, target double, _words long, _ends array<long>")
    blocks = blocks_for(max([r["n"] for r in summed], default=0))
    block = F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(blocks))
    rows = running(rows, ["source"], block, [F.col("_order"), F.col("doc_id"), F.col("size"), *map(F.col, keys)], F.col("size"), "_from")
    rows = rows.join(small(given, len(planned), 256), F.col("source").eqNullSafe(F.col("_source")), "left")
    passes, rest = F.expr("_words div greatest(source_size, 1L)"), F.expr("_words % greatest(source_size, 1L)")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_from")))
    rows = rows.select("*", (passes * F.col("size") + part).alias("taken"), part.alias("_part"), passes.alias("_passes"))

    def shard_at(word: Column) -> Column:
        return F.when(F.col("taken") > 0, F.size(F.filter("_ends", lambda e: e <= word)))

    last = F.when(F.col("_part") > 0, F.col("_passes") * F.col("source_size") + F.col("_from") + F.col("_part") - 1).otherwise((F.col("_passes") - 1) * F.col("source_size") + F.col("_from") + F.col("size") - 1)
    ranges = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes")), lambda k: F.struct((k * F.col("source_size") + F.col("_from")).alias("a"), F.when(k < F.col("_passes"), F.col("size")).otherwise(F.col("_part")).alias("n")))

    def share(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("_ends", F.when(i == 0, 1).otherwise(i)))
        words = F.aggregate(ranges, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0).cast("long"), F.least(end, x["a"] + x["n"]) - F.greatest(start, x["a"])))
        return F.struct(i.alias("shard"), words.alias("words"))

    rows = rows.withColumn("first_shard", shard_at(F.col("_from"))).withColumn("last_shard", shard_at(last))
    dealt = F.filter(F.transform("_ends", share), lambda x: x["words"] > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "last_shard", dealt.alias("shards"), "_part", "_passes", *keys)


def mixed_rows(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of docs: a document is repeated for each time it is
    taken whole; one that the last block cuts comes with its first words only, and text_col alone
    is cut. Documents of no words are taken as often as their source is passed through whole.
    Rows are told apart by a written key, so ids may be null or repeated."""
    id_, source, text = (F.col(f"`{c}`") for c in (id_col, source_col, text_col))
    rows = written(packed_rows(docs, _row=F.monotonically_increasing_id(), _text_hash=F.xxhash64(text), _i=id_.cast("long"), _s=source.cast("string"), _n=words_in(text)), "keyed")
    found = _mix(rows.select(F.col("_i").alias("doc_id"), F.col("_s").alias("source"), F.col("_n").alias("size"), "_text_hash", "_row"), seed, 24, "_text_hash", "_row")
    found = written(found.select(F.col("_row").alias("_key"), "_passes", "_part", F.col("size").alias("_size")), "mix")
    rows = join_in_place(rows, found, "_row", "_key", found.count(), 96, "inner", "mixed")
    whole = F.when(F.col("_part") == F.col("_size"), F.col("_passes") + F.when(F.col("_size") > 0, 1).otherwise(0)).otherwise(F.col("_passes")).cast("int")
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    text = F.col(f"_doc.`{text_col}`")
    # cut after each word: the first _part pieces are the text up to there, white space as it was
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")
    copies = F.concat(F.array_repeat(text, whole), F.when(cut, F.array(first)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_copy", F.explode(copies))
    return rows.select(*[F.col("_copy").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns])
