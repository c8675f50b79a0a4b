"""Exact joins of token sets by Jaccard similarity: candidates for the operators' own checks.

A set of n tokens can have a similar one only if at most n - ceil(percent * n / 100) of its
tokens are its alone.  The tokens with a hash in the lowest ``SAMPLED`` part are counted over
all sets, packed into blocks rather than rows; sets with too many of their own among these
are done.  This drops no link, as it counts real tokens of their own, only not all of them.

For the rest, a set's prefix holds so many of its first tokens, in one order of all tokens,
that two similar sets share one there.  Frequent tokens come last in that order: the counted
ones held by at least a ``COMMON_SHARE`` of all entries, so their number is bounded and their
list may travel.  All other tokens go by their hash.  Any order gives the same links; this
one keeps passages that many texts share out of most prefixes.

A prefix token's sets gather around the smallest of them.  Each set is matched around its
smallest such centre first, in chunks of bounded size.  Where links have not made all the
sets around one centre a single component, they meet in blocks of bounded size, every block
with every other, those of one and the same component excepted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow.llm.base import components, given_back, remove, saved

SAMPLED = 0.4
COMMON_SHARE = 1 / 400_000
COMMON_LEAST = 64
BUCKET_TOKENS = 1_500_000
PART_SETS = 50_000
CHUNK_SETS = 192
CHUNK_TOKENS = 400_000
FLUSH_TOKENS = 1 << 19
SIEVE_BITS = 1 << 26  # 8 MB
SEGMENT_BITS = 1 << 20

SAMPLED_TOP = np.uint64(int(SAMPLED * 2**64) - 1)
_LOW = np.uint64((1 << 40) - 1)

# (key of a set or None, its tokens: distinct hashes, or at least those of the sampled part) for every row of a batch.
# A token that comes twice only seems to be shared.
Reader = Callable[[pa.RecordBatch], Iterator[tuple[bytes | None, np.ndarray]]]
# A chunk's sets (tokens in order) and the percent to pairs of positions that connect what is similar.
Match = Callable[[list[np.ndarray], int], list[tuple[int, int]]]

def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shared tokens from which sets of sizes a and b are similar."""
    return -(-percent * (a + b) // (100 + percent))


def short_name(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _short(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low bits of a token; a rare clash only makes a token seem shared."""
    return ((tokens >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (tokens & _LOW)


def _packed(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _dealer(reader: Reader, buckets: int):
    """Sampled tokens by bucket, from blocks of sets: those of one set in the block with its
    short name, and those of several without."""
    top = SAMPLED_TOP
    kinds = (pa.int64(), *[pa.binary()] * 5)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            short = _short(np.concatenate(list(block.values())), buckets)
            owner = np.repeat(np.fromiter(block, np.int64, len(block)), [len(t) for t in block.values()])
            order = np.argsort(short)  # of equal ones the order does not matter
            short, owner = short[order], owner[order]
            start = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.empty(0, np.int64)
            held = np.diff(np.append(start, len(short)))
            one, many = start[held == 1], start[held > 1]
            limits = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40)
            cut_one, cut_many = np.searchsorted(short[one], limits), np.searchsorted(short[many], limits)
            data = []
            for k in range(buckets):
                mine, shared = one[cut_one[k] : cut_one[k + 1]], many[cut_many[k] : cut_many[k + 1]]
                if len(mine) or len(shared):
                    by = np.argsort(owner[mine])
                    ordered = owner[mine][by]
                    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(mine) else mine
                    names, count = ordered[first], np.diff(np.append(first, len(mine)))
                    data.append((
                        k, names.tobytes(), count.astype(np.int32).tobytes(), _packed(short[mine][by]),
                        _packed(short[shared]), held[held > 1][cut_many[k] : cut_many[k + 1]].astype(np.int32).tobytes(),
                    ))
            columns = zip(*data) if data else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                ["bucket", "names", "counts", "single", "shared", "held"],
            )

        for batch in batches:
            for key, tokens in reader(batch):
                if key is not None and (name := short_name(key)) not in block:
                    block[name] = tokens[tokens <= top]
                    size += len(block[name]) + 1
                    if size >= FLUSH_TOKENS:
                        yield flush()
                        block, size = {}, 0
        if block:
            yield flush()

    return rows


def _summed(group: pa.Table) -> pa.Table:
    """Of one part of the sets: how many tokens each has alone, over all buckets."""
    names = np.frombuffer(b"".join(group.column("names").to_pylist()), np.int64)
    alone = np.frombuffer(b"".join(group.column("alone").to_pylist()), np.int32)
    order = np.argsort(names, kind="stable")
    start = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    return pa.table({
        "fp": pa.array(names[order][start], pa.int64()),
        "alone": pa.array(np.add.reduceat(alone[order].astype(np.int64), start), pa.int64()),
    })


def _counting(common: int, parts: int):
    """Of one bucket: how many tokens each set has alone, and the tokens held by many."""

    def rows(group: pa.Table) -> pa.Table:
        names, counts, single, shared, held = (
            b"".join(group.column(c).to_pylist()) for c in ("names", "counts", "single", "shared", "held")
        )
        owner = np.repeat(np.frombuffer(names, np.int64), np.frombuffer(counts, np.int32))
        single, shared = _unpacked(single), _unpacked(shared)
        tokens = np.concatenate([single, shared])
        count = np.concatenate([np.ones(len(single), np.int64), np.frombuffer(held, np.int32)])
        owner = np.concatenate([owner, np.zeros(len(shared), np.int64)])
        order = np.argsort(tokens)
        tokens, count, owner = tokens[order], count[order], owner[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        total, most = np.add.reduceat(count, start), np.maximum.reduceat(count, start)
        alone = (most == 1) & (np.minimum.reduceat(owner, start) == np.maximum.reduceat(owner, start))
        name, own = np.unique(owner[start[alone]], return_counts=True)
        often = total >= common
        short = tokens[start[often]] | np.uint64(group.column("bucket")[0].as_py() << 40)
        part = (name.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        each = [x for x in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(x)]
        m, k = len(each), len(short)
        return pa.table({
            "part": pa.concat_arrays([pa.array([int(part[x[0]]) for x in each], pa.int64()), pa.nulls(k, pa.int64())]),
            "names": pa.array([name[x].tobytes() for x in each] + [None] * k, pa.binary()),
            "alone": pa.array([own[x].astype(np.int32).tobytes() for x in each] + [None] * k, pa.binary()),
            "token": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(short.view(np.int64))]),
            "m": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(total[often], pa.int64())]),
        })

    return rows


# Buckets, the common tokens' short names in order, and the rank of each.
Order = tuple[int, np.ndarray, np.ndarray]


def _order(buckets: int, token: np.ndarray, held: np.ndarray) -> Order:
    rank = np.empty(len(token), np.uint64)
    rank[np.lexsort((token, held))] = np.arange(len(token), dtype=np.uint64)
    by = np.argsort(token)
    return buckets, token[by], rank[by]


def relabelled(tokens: np.ndarray, order: Order) -> np.ndarray:
    """The tokens as numbers that sort in the common order."""
    buckets, common, rank = order
    out = tokens >> np.uint64(1)
    if len(common):
        short = _short(tokens, buckets)
        at = np.minimum(np.searchsorted(common, short), len(common) - 1)
        hit = (common[at] == short) & (tokens < np.uint64(int(SAMPLED * 2**64)))
        # The low bits keep two tokens of one short name apart.
        out[hit] = (rank[at[hit]] << np.uint64(40)) | (tokens[hit] >> np.uint64(24)) | np.uint64(1 << 63)
    out.sort()
    return out


def _chunk_links(match: Match, percent: int):
    """Links of the chunks of a stream of rows (chunk, key, root, tokens) in which each chunk's rows stand together.

    A link is between the roots of two sets: each set's own key, or the key that stands for its component.

    A task keeps one chunk at a time, and saves the round trip that a grouped function
    takes for each.
    """
    def links_of(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[list[bytes], list[bytes]]:
        found = {key: (tokens, root) for key, tokens, root in parts}
        if len(found) < 2:
            return [], []
        keys = sorted(found)
        roots = [found[k][1] for k in keys]
        pairs = match([np.frombuffer(found[k][0], np.uint64) for k in keys], percent)
        # Sets of one component are connected already: a link for each two components that meet is enough.
        met = {(roots[i], roots[j]): None for i, j in pairs if roots[i] != roots[j]}
        return [a for a, _ in met], [b for _, b in met]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            one: list[bytes] = []
            two: list[bytes] = []
            sets = [*zip(*(batch.column(c).to_pylist() for c in ("key", "tokens", "root")))]
            for start, end in zip(cuts, cuts[1:]):
                if held and chunk[start] != last:
                    a, b = links_of(held)
                    one += a
                    two += b
                    held = []
                held += sets[start:end]
                last = chunk[start]
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["a", "b"])
        one, two = links_of(held)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["a", "b"])

    return rows


def stars(links: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Links among n things as (smallest, other) of each component, so that no chain is left."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        parent[b] = a
    return [(top(i), i) for i in range(n) if top(i) != i]


def _matched(where: DataFrame, sets: DataFrame, match: Match, percent: int) -> DataFrame:
    """Links within each chunk of (pivot, chunk, key, root)."""
    chunk = F.xxhash64("pivot", "chunk")  # two chunks of one hash are one: no pair is lost or wrong
    rows = where.select(chunk.alias("chunk"), "key", "root").join(sets.select("key", "tokens"), "key")
    rows = rows.select("chunk", "key", "root", "tokens").repartition("chunk").sortWithinPartitions("chunk")
    return rows.mapInArrow(given_back(_chunk_links(match, percent)), "a binary, b binary")


def least_size(percent: int) -> int:
    """Smaller sets are similar to equal ones only: of n and n + 1 tokens n would have to suffice."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def candidates(
    rows: DataFrame, reader: Reader, names: DataFrame, percent: int, counts: tuple[int, int] | None = None
) -> tuple[DataFrame, Order]:
    """(the sets that may have a similar one, the order of tokens).

    ``rows`` is what ``reader`` reads; ``names`` has a row (key, fp, n, ...) per set, n its
    tokens or more.  ``counts`` are about the sum of n and the number of sets; they choose the
    sizes of blocks and the order only.
    """
    total, sets = counts or names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(COMMON_LEAST, int(total * SAMPLED * COMMON_SHARE))
    buckets = int(total * SAMPLED // BUCKET_TOKENS) + 1
    dealt = rows.mapInArrow(
        given_back(_dealer(reader, buckets)), "bucket long, names binary, counts binary, single binary, shared binary, held binary"
    )
    counted, path = saved(
        dealt.groupBy("bucket").applyInArrow(
            _counting(least, sets // PART_SETS + 1), "part long, names binary, alone binary, token long, m long"
        ),
        "counted",
    )
    # Bounded: a common token has COMMON_SHARE of all entries at least.
    common = counted.where("token is not null").select("token", "m").toArrow()
    order = _order(buckets, common.column("token").to_numpy().view(np.uint64), common.column("m").to_numpy())
    alone = counted.where("part is not null").select("part", "names", "alone").groupBy("part").applyInArrow(
        _summed, "fp long, alone long"
    )
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    left, _ = saved(names.join(alone, "fp", "left").where(F.coalesce("alone", F.lit(0)) <= spare).drop("alone", "fp"), "candidates")
    remove(rows.sparkSession, path)
    return left, order


def spot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))


def sieve(chosen: DataFrame) -> bytes:
    """A bitmap of the ``spot`` of chosen rows: of fixed size, made in segments.

    What it lets pass is a superset of the chosen rows; it only saves shuffling the rest.
    """

    def segment(group: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        bits[group.column("spot").to_numpy() % SEGMENT_BITS] = 1
        at = group.column("segment")[0].as_py()
        return pa.table({"segment": pa.array([at], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    placed = chosen.select("spot", F.floor(F.col("spot") / SEGMENT_BITS).alias("segment")).distinct()
    parts = placed.groupBy("segment").applyInArrow(segment, "segment long, bits binary").collect()
    whole = bytearray(SIEVE_BITS // 8)
    for r in parts:
        whole[r["segment"] * SEGMENT_BITS // 8 : (r["segment"] + 1) * SEGMENT_BITS // 8] = r["bits"]
    return bytes(whole)


def passing(batch: pa.RecordBatch, bits: bytes) -> pa.RecordBatch:
    at = batch.column("spot").to_numpy()
    return batch.filter(pa.array((np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))


def links(sets: DataFrame, match: Match, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets (key, n, tokens, prefix) that connect all similar ones and no others.

    ``tokens`` are numbers in the common order, ``prefix`` the first of them as an array.
    """
    spark = sets.sparkSession
    entries = sets.select("key", "n", F.explode("prefix").alias("token"))
    pivots = entries.groupBy("token").agg(F.min("key").alias("pivot"), F.max("key").alias("last"))
    pivots = pivots.where(F.col("pivot") != F.col("last")).select("token", "pivot")
    members, at_members = saved(entries.join(pivots, "token").select("pivot", "key", "n").distinct(), "members")
    # Each set meets its smallest pivot first, which connects most copies of a text.
    nearest = members.groupBy("key").agg(F.min("pivot").alias("pivot"), F.first("n").alias("n")).where("key != pivot")
    first, _ = saved(_matched(_chunks(nearest).withColumn("root", F.col("key")), sets, match, percent), "links")
    labels = components(first).withColumnRenamed("node", "key")
    named = members.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = named.groupBy("pivot").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("pivot")
    rest, at_rest = saved(named.join(apart, "pivot", "left_semi"), "unresolved")
    if rest.limit(1).count():
        more, _ = saved(_matched(blocks(rest, percent), sets, match, percent), "links")
        first = first.union(more)
    remove(spark, at_members, at_rest)
    return first


def _width(count, tokens):
    return F.greatest(F.ceil(count / CHUNK_SETS), F.ceil(tokens / CHUNK_TOKENS)).cast("int")


def _chunks(members: DataFrame) -> DataFrame:
    """(pivot, chunk, key): a pivot's sets in chunks of bounded size, each with the pivot."""
    width = members.groupBy("pivot").agg(_width(F.count("*"), F.sum("n")).alias("width"))
    placed = members.join(width, "pivot").select("pivot", F.pmod(F.xxhash64("key"), F.col("width")).alias("chunk"), "key")
    centres = width.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("chunk"), F.col("pivot").alias("key")
    )
    return placed.union(centres)


def blocks(named: DataFrame, percent: int) -> DataFrame:
    """(pivot, chunk, key, root): in each pivot's sets (pivot, key, n, root), block against block.

    Blocks hold sets of similar size, so that few of them are worth meeting; large
    components have blocks of their own, which do not meet themselves.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)))
    named = named.withColumn("band", band)
    by_root = named.groupBy("pivot", "root", "band").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    large = (F.col("m") >= CHUNK_SETS) | (F.col("t") >= CHUNK_TOKENS)
    by_root = by_root.withColumn("own", F.when(large, F.hex("root")).otherwise(""))
    sizes = by_root.groupBy("pivot", "own", "band").agg(_width(F.sum("m"), F.sum("t")).alias("width"))
    owns = by_root.select("pivot", "root", "own", "band").join(sizes, ["pivot", "own", "band"])
    part = F.pmod(F.xxhash64("key"), F.col("width"))
    placed, _ = saved(
        named.join(owns, ["pivot", "root", "band"]).select("pivot", "key", "root", "n", "own", "band", part.alias("part")), "placed"
    )
    blocks = placed.groupBy("pivot", "own", "band", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    blocks = blocks.withColumn("block", F.xxhash64("pivot", "own", "band", "part"))
    other = blocks.select("pivot", *(F.col(c).alias(f"{c}_2") for c in ("own", "least", "most", "block")))
    pairs = blocks.join(other, "pivot").where(
        (F.col("block") <= F.col("block_2"))
        & ((F.col("own") == "") | (F.col("own") != F.col("own_2")))
        & (100 * F.col("most") >= percent * F.col("least_2"))
        & (100 * F.col("most_2") >= percent * F.col("least"))
    ).select("pivot", "block", "block_2", F.xxhash64("block", "block_2").alias("chunk"))
    sides = pairs.select("pivot", "chunk", "block").union(pairs.select("pivot", "chunk", "block_2")).distinct()
    return placed.withColumn("block", F.xxhash64("pivot", "own", "band", "part")).join(sides, ["pivot", "block"]).select("pivot", "chunk", "key", "root")
