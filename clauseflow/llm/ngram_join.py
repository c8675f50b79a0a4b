"""N-gram Jaccard join (7): documents with similar shingle sets, by a prefix tree.

Sets of globally ordered shingles are stored in a trie.  A probe walks it with the overlap
it has so far, so sets that begin alike share that work, and leaves a branch when what
remains of the probe and of the longest set below cannot reach the overlap still needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm import setjoin
from clauseflow.llm.base import components, given_back, query, saved, table, text_key
from clauseflow.llm.shingles import WORDS_PER_SHINGLE, shingle_sets

PERCENT = 75


class _Node:
    __slots__ = ("below", "edge", "ends", "largest", "smallest")

    def __init__(self, edge: np.ndarray, size: int):
        self.edge, self.below, self.ends = edge, {}, []
        self.smallest = self.largest = size


class PrefixTree:
    """A path-compressed trie of sets that are sorted arrays of small numbers."""

    def __init__(self) -> None:
        self.root = _Node(np.empty(0, np.int64), 0)

    def add(self, tokens: np.ndarray, name: int) -> None:
        size, at, node = len(tokens), 0, self.root
        while at < size:
            child = node.below.get(tokens[at])
            if child is None:
                child = node.below[tokens[at]] = _Node(tokens[at:], size)
                child.ends.append((name, size))
                return
            own = child.edge[: size - at]
            apart = np.flatnonzero(own != tokens[at : at + len(own)])
            same = int(apart[0]) if len(apart) else len(own)
            if same < len(child.edge):
                upper = _Node(child.edge[:same], size)
                upper.smallest, upper.largest = child.smallest, child.largest
                child.edge = child.edge[same:]
                upper.below[child.edge[0]] = child
                node.below[tokens[at]] = upper
                child = upper
            child.smallest, child.largest = min(child.smallest, size), max(child.largest, size)
            at, node = at + same, child
        node.ends.append((name, size))

    def similar(self, tokens: np.ndarray, universe: int, percent: int) -> Iterator[int]:
        """Names of the stored sets that are similar to the probe."""
        size = len(tokens)
        held = np.zeros(universe, np.int64)
        held[tokens] = 1
        later = size - np.cumsum(held)  # probe tokens after a token
        stack = [(child, 0, 0) for child in self.root.below.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if 100 * node.largest < percent * size:
                continue
            overlap += int(held[node.edge].sum())
            depth += len(node.edge)
            needed = setjoin.least_overlap(size, max(node.smallest, -(-percent * size // 100)), percent)
            if overlap + min(int(later[node.edge[-1]]), node.largest - depth) < needed:
                continue
            for name, other in node.ends:
                if 100 * overlap >= percent * (size + other - overlap):
                    yield name
            stack += [(child, overlap, depth) for child in node.below.values()]


def tree_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a chunk; the sets enter by growing size."""
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    small = np.split(at, np.cumsum([len(s) for s in sets])[:-1])
    tree = PrefixTree()

    def found() -> Iterator[tuple[int, int]]:
        for i in sorted(range(len(small)), key=lambda i: len(small[i])):
            for j in tree.similar(small[i], len(flat), percent):
                yield i, j
            tree.add(small[i], i)

    return setjoin.stars(found(), len(small))


def _reader(size: int) -> setjoin.Reader:
    def sets(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, np.ndarray]]:
        return shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], size)

    return sets


def _namer(reader: setjoin.Reader):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [(k, k and setjoin.short_name(k), len(s)) for k, s in reader(batch)]
            columns = zip(*named) if named else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("ref")]
                + [pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()))],
                ["doc", "ref", "key", "fp", "n"],
            )

    return rows


def _orderer(reader: setjoin.Reader, percent: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits = shared.value
        for batch in batches:
            batch = setjoin.passing(batch, bits)
            data = [(k, setjoin.relabelled(s, order)) for k, s in reader(batch)]
            first = [s[: setjoin.prefix_length(len(s), percent)].view(np.int64) for _, s in data]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array([k for k, _ in data], pa.binary()),
                    pa.array([len(s) for _, s in data], pa.int32()),
                    pa.array([s.tobytes() for _, s in data], pa.binary()),
                    pa.array(first, pa.list_(pa.int64())),
                ],
                ["doc", "key", "n", "tokens", "prefix"],
            )

    return rows


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    size: int = WORDS_PER_SHINGLE, percent: int = PERCENT, match: setjoin.Match = tree_links,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * intersection >= percent * union of their distinct
    ``size``-word shingles (A-Z in lower case; fewer words: the whole sequence).  A
    component is named by the smallest id that links reach.  Texts that are null, empty
    or blank have no shingle and link with nothing.  Equal texts are one set, however
    often they come; repeated rows give repeated rows.  A null id is kept, and never names
    a component that has another id.  Other columns are not read.
    """
    names, keys = linked_sets(docs, id_col, text_col, size, percent, match)
    keys = keys.join(names.where("key is not null").groupBy("key").agg(F.min("doc").alias("first")), "key")
    least = keys.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keys.join(least, "root").select("key", "component_id")
    return names.select("doc", "key", "n").join(named, "key", "left").select(
        F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
    )


def linked_sets(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, match: setjoin.Match
) -> tuple[DataFrame, DataFrame]:
    """((doc, ref, key, n) of every row, (key, root) of every set): sets of one component have one root.

    ``ref`` tells texts apart, ``key`` names a text's set and is null without one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.withColumn("ref", text_key("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    reader = _reader(size)
    names, _ = saved(
        rows.mapInArrow(given_back(_namer(reader)), f"doc {id_type}, ref string, key binary, fp long, n int"), "named"
    )
    one = names.where("key is not null").groupBy("key", "fp", "n").agg(F.min(F.struct("ref", "doc")).alias("one"))
    left, order = setjoin.candidates(rows.select("text"), reader, one, percent)
    left = left.select(F.col("key").alias("of"), F.col("one.doc").alias("one"), F.col("one.ref").alias("ref"))
    bits = setjoin.sieve(left.select(setjoin.spot("ref", "one").alias("spot")))
    made = rows.select("doc", "text", setjoin.spot("ref", "doc").alias("spot")).mapInArrow(
        given_back(_orderer(reader, percent, spark.sparkContext.broadcast((order, bits)))),  # both of bounded size
        f"doc {id_type}, key binary, n int, tokens binary, prefix array<long>",
    )
    chosen = (F.col("key") == F.col("of")) & F.col("doc").eqNullSafe(F.col("one"))
    sets, _ = saved(made.join(left, chosen, "left_semi").drop("doc"), "sets")
    roots = components(setjoin.links(sets, match, percent))
    keys = names.where("key is not null").select("key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left")
    return names, keys.withColumn("root", F.coalesce("root", "key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component: of the smallest id (rows without one last) and text key.

    Rows are told apart by id and text, so a text of its own stays whatever row shares its id, and
    of rows with equal id and text one stays.  Texts without a word are no component: all
    their rows stay.  All columns stay, whatever their names; no rows give no rows.
    """
    names, keys = linked_sets(docs, id_col, text_col, WORDS_PER_SHINGLE, PERCENT, tree_links)
    rows, _ = saved(names.where("key is not null").join(keys, "key").groupBy("root", "doc", "ref").agg(F.count("*").alias("m")), "members")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "ref")).alias("first"))
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("ref") == F.col("first.ref"))
    judged = rows.join(first, "root").select(F.col("doc").alias("_doc"), F.col("ref").alias("_of"), stays.alias("_stays"), "m")
    judged, _ = saved(judged.where("not _stays or m > 1"), "judged")
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_ref") == F.col("_of"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), text_key(text_col).alias("_ref"))
    once = whole.join(judged, same, "left_anti")
    # Rows that are there several times: one of each, the least by all its columns.
    again = whole.join(judged.where("_stays"), same, "left_semi").groupBy("_id", "_ref").agg(F.min("_row").alias("_row"))
    return once.select("_row").union(again.select("_row")).select("_row.*")


@query()
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
