"""Line dedup (8): an exact set-similarity join of lines by prefix, position and length.

A line's tokens are its word shingles, rare ones first.  Lines are candidates if their
prefixes share a token; a pair is dropped when its lengths differ too much or when, at a
shared token, what has been seen and what can still come is below the overlap needed; the
rest is verified by counting.  Of a class of linked lines the first stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm import setjoin
from clauseflow.llm.base import components, given_back, query, saved, table
from clauseflow.llm.ngram_join import PERCENT
from clauseflow.llm.shingles import mixed, sampled_shingles, sequence_names, shingle_sets

STRIDE = 7919  # between the places of a document's lines in the bitmap


def shared_tokens(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of the others; none is empty."""
    tokens = np.concatenate(others)
    at = np.searchsorted(one, tokens)
    at[at == len(one)] = 0
    return np.add.reduceat(one[at] == tokens, np.cumsum([0, *(len(s) for s in others[:-1])]), dtype=np.int64)


def prefix_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a chunk; what is connected already is not compared."""
    sizes = [len(s) for s in sets]
    if len(sets) == 2:  # as most chunks are
        [both] = shared_tokens(sets[0], sets[1:]).tolist()
        return [(0, 1)] if 100 * both >= percent * (sum(sizes) - both) else []
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    group = list(range(len(sets)))  # grows together as links come, like what ``stars`` makes of them
    members = [[i] for i in group]
    links: list[tuple[int, int]] = []

    def link(i: int, others: list[int]) -> None:
        if not others:
            return
        for j, both in zip(others, shared_tokens(sets[i], [sets[j] for j in others]).tolist()):
            if group[i] != group[j] and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((i, j))
                gone, into = sorted((group[i], group[j]), key=lambda g: len(members[g]))
                for k in members[gone]:
                    group[k] = into
                members[into] += members[gone]

    for i in sorted(range(len(sets)), key=sizes.__getitem__):
        size, mine = sizes[i], group[i]
        seen: dict[int, int] = {}
        tried = False
        prefix = sets[i][: setjoin.prefix_length(size, percent)].tolist()
        for at, token in enumerate(prefix):
            for j, place in index[token]:
                if group[j] == mine or (count := seen.get(j, 0)) < 0:
                    continue
                other = sizes[j]
                rest = min(size - at, other - place) - 1
                # As setjoin.least_overlap, without a call for each shared token.
                fits = 100 * other >= percent * size and (100 + percent) * (count + 1 + rest) >= percent * (size + other)
                if fits and not tried:
                    # The first that fits is compared at once: with it, most others are often connected already.
                    link(i, [j])
                    mine, seen[j], tried = group[i], -1, True
                else:
                    seen[j] = count + 1 if fits else -1
        likely = sorted((j for j, count in seen.items() if count > 0), key=lambda j: -seen[j])
        link(i, likely[:1])
        link(i, [j for j in likely[1:] if group[j] != group[i]])
        for at, token in enumerate(prefix):
            index[token].append((i, at))
    return setjoin.stars(iter(links), len(sets))


def _lines(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """(row, number, bytes) of every line with a word in a batch of texts."""
    rows, numbers, lines = [], [], []
    for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        for n, line in enumerate((text or b"").split(b"\n")):
            if line.strip():  # the six ASCII spaces
                rows.append(k)
                numbers.append(n)
                lines.append(line)
    return rows, numbers, lines


def _reader(percent: int) -> setjoin.Reader:
    """The sets of lines that may have a similar one; what can only have an equal one is left out."""
    least = setjoin.least_size(percent)

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, np.ndarray]]:
        return sampled_shingles(_lines(batch)[2], least, setjoin.SAMPLED_TOP)

    return sets


def _ids(spots: np.ndarray, rows: list[int], numbers: list[int]) -> np.ndarray:
    """A number for every line, from its document's hash and its place."""
    return mixed(spots.view(np.uint64)[rows] + np.array(numbers, np.uint64) * np.uint64(STRIDE))


def _namer(percent: int):
    least = setjoin.least_size(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, lines = _lines(batch)
            named = [(k, setjoin.short_name(k), n) for k, n in sequence_names(lines, least)]
            columns = zip(*named) if named else ((), (), ())
            kinds = (pa.binary(), pa.int64(), pa.int32())
            ids = _ids(batch.column("spot").to_numpy(), places, numbers) if places else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(places, pa.int64())), pa.array(numbers, pa.int32())]
                + [pa.array(list(c), t) for c, t in zip(columns, kinds)] + [pa.array(ids.view(np.int64))],
                ["doc", "line", "key", "fp", "n", "id"],
            )

    return rows


def _orderer(percent: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits = shared.value
        held = np.frombuffer(bits, np.uint8)
        for batch in batches:
            rows, numbers, lines = _lines(batch)
            ids = _ids(batch.column("spot").to_numpy(), rows, numbers) if rows else np.empty(0, np.uint64)
            spots = (ids % np.uint64(setjoin.SIEVE_BITS)).astype(np.int64)
            mine = np.flatnonzero(held[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).tolist()
            data = [(k, setjoin.relabelled(s, order)) for k, s in shingle_sets([lines[i] for i in mine])]
            first = [s[: setjoin.prefix_length(len(s), percent)].view(np.int64) for _, s in data]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[mine].view(np.int64)),
                    pa.array([k for k, _ in data], pa.binary()),
                    pa.array([len(s) for _, s in data], pa.int32()),
                    pa.array([s.tobytes() for _, s in data], pa.binary()),
                    pa.array(first, pa.list_(pa.int64())),
                ],
                ["id", "key", "n", "tokens", "prefix"],
            )

    return rows


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per line that goes: id, ``line``, and the document and line that stay for it.

    Two lines link when their distinct five-word shingles (fewer words: the whole line) have
    a Jaccard similarity of ``percent`` or more; linked lines are a class, of which the
    first by id and line stays.  Null and empty texts have no lines; blank lines are left
    alone; rows without an id come first; rows that share an id share their line numbers.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("spot", F.xxhash64("doc"))
    kind = rows.schema["doc"].dataType.simpleString()
    names, _ = saved(rows.mapInArrow(given_back(_namer(percent)), f"doc {kind}, line int, key binary, fp long, n int, id long"), "lines")
    # One line of each set stands for it: that with the least number, so the aggregate needs no order of documents.
    long = names.where(F.col("n") >= setjoin.least_size(percent))
    m, tokens, distinct = long.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.approx_count_distinct("fp")).first()
    # Dealt by the name that the counts come by, so that the rows move once.
    one = long.select("key", "fp", "n", "id").repartition("fp").groupBy("key", "fp", "n").agg(F.min("id").alias("one"))
    counts = (tokens * distinct // max(m, 1), distinct)
    left, order = setjoin.candidates(rows.select("text"), _reader(percent), one, percent, counts)
    left = left.select("one")
    bits = setjoin.sieve(left.select(F.pmod("one", F.lit(setjoin.SIEVE_BITS)).alias("spot")))
    made = rows.mapInArrow(
        given_back(_orderer(percent, spark.sparkContext.broadcast((order, bits)))),  # both of bounded size
        "id long, key binary, n int, tokens binary, prefix array<long>",
    )
    # Rows that share an id share their lines' numbers: then more sets come along, none is lost.
    sets, _ = saved(made.join(left, F.col("id") == F.col("one"), "left_semi").drop("id"), "sets")
    roots = components(setjoin.links(sets, prefix_links, percent)).withColumnRenamed("node", "key")
    # Only sets that are linked or come twice are looked at again.
    often = names.groupBy("key").agg(F.count("*").alias("m")).join(roots, "key", "left").where("m > 1 or root is not null")
    often = often.select("key", F.coalesce("root", "key").alias("root"))
    members, _ = saved(names.select("key", "doc", "line").join(often, "key").drop("key"), "members")
    kept = members.groupBy("root").agg(F.min(F.struct("doc", "line")).alias("kept"))
    gone = members.join(kept, "root").where(
        ~(F.col("doc").eqNullSafe(F.col("kept.doc")) & (F.col("line") == F.col("kept.line")))
    )
    return gone.select(
        F.col("doc").alias(id_col), F.col("line").cast("long").alias("line"),
        F.col("kept.doc").alias(f"kept_{id_col}"), F.col("kept.line").cast("long").alias("kept_line"),
    )


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))
