"""The chunk store: append-only Parquet with removals, read as of the last commit.

A commit adds ``chunks/v=N`` (a folder per type, bucketed by source), ``documents/v=N`` (the
few columns that tell stored documents apart, twice: in parts by hash and in parts by
source), ``blooms/v=N`` (a Bloom filter of the keys of each part), ``removed/v=N`` (bucketed as the
chunks are), ``status/v=N`` (signed counts by service, type and subtype) and, last of all, the marker
``commits/v=N``.  Its cost follows the batch, not the store: no row of an earlier version
is rewritten, and documents are looked up only in parts whose filter knows one of the
batch's keys.  A job that dies before the marker leaves a version no reader looks at and
the next commit overwrites.  Removed sources meet the chunks bucket by bucket, so no text is
shuffled to leave them out.  ``fold`` writes small versions together as one that stands
for them, so their number grows with the logarithm of the commits.  One job writes at a
time: a commit holds the file ``lock`` while it runs, and a second writer fails; ``unlock`` frees
a store whose job died.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from clauseflow.operators.cells import Cells
from clauseflow.session import bounded_batches, written

CHUNK_SCHEMA = (
    "chunk_id string, document string, doc_type string, doc_subtype string, "
    "service_name string, source string, source_label string, source_kind string, "
    "scope string, chunk_index int, article string, article_no string, "
    "question string, answer string, content_hash string, document_hash string, "
    "ingest_schema_version int, updated_at timestamp, vector array<float>, "
    "keyword_bits array<bigint>, cell int, cell_distance double"
)
DOCUMENT_SCHEMA = (
    "source string, service_name string, doc_type string, doc_subtype string, "
    "source_kind string, document_hash string, ingest_schema_version int, n_chunks bigint"
)
STATUS_SCHEMA = "service_name string, doc_type string, doc_subtype string, documents bigint, chunks bigint"
MARKER_SCHEMA = "first int, txns array<string>, n_chunks bigint, n_removed bigint, n_documents bigint, parts int"
KINDS = ("chunks", "documents", "blooms", "removed", "status", "commits")

SENT_REMOVALS = 100_000  # sources; up to so many the removals travel to the chunks
PART_DOCUMENTS = 100_000  # documents of a part, about; a small version is one part
SMALL_VERSION = 10_000  # documents; up to so many are read whole and have no filters
ONE_TASK_REMOVALS = 10_000
BITS_PER_KEY = 10
PROBES = 7
LISTED_PARTS = 5_000  # parts that a filter names one by one; beyond it, it names them without their version
FOLD_ABOVE = 8


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# ----------------------------------------------------------- Bloom filters
def _probes(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """The positions of keys in a filter of so many bits (keys x probes)."""
    steps = np.arange(PROBES, dtype=np.uint64)
    return (one.astype(np.uint64)[:, None] + steps * (two.astype(np.uint64) | np.uint64(1))[:, None]) % np.uint64(bits)


def _bloom(keys: pa.Table) -> pa.Table:
    """One filter of a part's keys."""
    bits = 64 * -(-BITS_PER_KEY * keys.num_rows // 64)
    flags = np.zeros(bits, np.uint8)
    flags[_probes(keys.column("one").to_numpy(), keys.column("two").to_numpy(), bits).ravel()] = 1
    held = [keys.column("by")[:1], keys.column("part")[:1], pa.array([np.packbits(flags).tobytes()], pa.binary())]
    return pa.table(held, names=["by", "part", "bits"])


def _known(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The versions, of those with one number of parts, whose filter of a part knows one of the keys."""
    found = []
    if keys.num_rows:
        one, two = keys.column("one").to_numpy(), keys.column("two").to_numpy()
        for k, packed in enumerate(filters.column("bits")):
            flags = np.unpackbits(np.frombuffer(packed.as_py(), np.uint8))
            if flags[_probes(one, two, len(flags))].all(axis=1).any():
                found.append(k)
    return filters.select(["v", "part"]).take(pa.array(found, pa.int64()))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit(1)).alias("two")]


def _part(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), parts).cast("int")


class ChunkStore:
    """``buckets`` (default: the session's shuffle width) is fixed when the store is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self._buckets = spark, buckets
        bounded_batches(spark)
        there, system = self._system(root)
        self.root = system.makeQualified(there).toString().rstrip("/")

    # -------------------------------------------------------------- files
    def _path(self, kind: str, version: int | None = None) -> str:
        return f"{self.root}/{kind}" + ("" if version is None else f"/v={version}")

    def _system(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        there, system = self._system(path)
        return system.exists(there)

    def buckets(self) -> int:
        path = self._path("layout")
        if self._exists(path):
            self._buckets = self.spark.read.schema("buckets int").parquet(path).first()[0]
        elif self._buckets is None:
            self._buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._buckets

    def _rows(self, kind: str, schema: str, versions: Iterable[int]) -> DataFrame:
        versions = list(versions)
        if not versions or not self._exists(self._path(kind)):
            return self.spark.createDataFrame([], schema + ", v int")
        rows = self.spark.read.schema(schema + ", v int").parquet(self._path(kind))
        return rows.where(F.col("v").isin(versions))

    def _bucketed(self, kind: str, columns: str, folders: str, version: int) -> DataFrame:
        """The versions up to this one as a table whose buckets Spark knows.

        A version does not change once it is committed, so the name of a version's table may be
        used again; the table owns no file.
        """
        name = f"clauseflow_{kind}_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{version}"
        if not self.spark.catalog.tableExists(name):
            path = self._path(kind)
            there, system = self._system(path)
            system.mkdirs(there)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {folders}) USING parquet "
                f"PARTITIONED BY ({', '.join(_names(folders))}) CLUSTERED BY (source) INTO {self.buckets()} BUCKETS "
                f"LOCATION '{path}'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def _write_bucketed(self, rows: DataFrame, path: str, folders: tuple[str, ...], order: tuple[str, ...]) -> None:
        name, n = f"clauseflow_write_{uuid.uuid4().hex}", self.buckets()
        writer = rows.write.mode("overwrite").format("parquet").option("path", path)
        writer = writer.partitionBy(*folders) if folders else writer
        writer.bucketBy(n, "source").sortBy(*order).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    # ------------------------------------------------------------- commits
    def _markers(self) -> list[Row]:
        """One row per commit, newest first; ``fold`` keeps them few."""
        if not self._exists(self._path("commits")):
            return []
        return sorted(self.spark.read.schema(f"{MARKER_SCHEMA}, v int").parquet(self._path("commits")).collect(), key=lambda m: -m.v)

    def _live(self, version: int | None = None) -> list[Row]:
        """The commits that hold the store's rows, newest first: those for which no later one stands."""
        out: list[Row] = []
        for m in self._markers():
            if (version is None or m.v <= version) and (not out or m.v < out[-1].first):
                out.append(m)
        return out

    def version(self) -> int:
        return max((m.v for m in self._markers()), default=0)

    def has_transaction(self, txn: str) -> bool:
        """Of numbered transactions (``name:number``) a later one implies the earlier ones."""
        name, _, number = txn.rpartition(":")
        for held in (t for m in self._markers() for t in m.txns):
            other, _, at = held.rpartition(":")
            if held == txn or (name and name == other and number.isdigit() and at.isdigit() and int(at) >= int(number)):
                return True
        return False

    # --------------------------------------------------------------- reads
    def read(self, version: int | None = None) -> DataFrame:
        """Chunks as of the last committed version (or an earlier one that no fold has replaced)."""
        return self._chunks(self._live(version))

    def _chunks(self, live: list[Row]) -> DataFrame:
        names = _names(CHUNK_SCHEMA)
        if not live:
            return self.spark.createDataFrame([], CHUNK_SCHEMA)
        columns = ", ".join(c for c in CHUNK_SCHEMA.split(", ") if not c.startswith("doc_type "))
        rows = self._bucketed("chunks", columns, "v int, doc_type string", live[0].v)
        return self._kept(rows.where(F.col("v").isin([m.v for m in live])), live).select(*names)

    def _kept(self, rows: DataFrame, live: list[Row]) -> DataFrame:
        """Rows (with ``v``) whose source was not removed by a later version.

        The removals are sent to the rows while they are few, and meet them bucket by bucket,
        with no shuffle of either side, when they are many.
        """
        total = sum(m.n_removed for m in live)
        if not total:
            return rows
        removed = self._bucketed("removed", "source string", "v int", live[0].v).where(F.col("v").isin([m.v for m in live]))
        gone = removed.groupBy("source").agg(F.max("v").alias("_gone"))
        gone = F.broadcast(gone) if total <= SENT_REMOVALS else gone.hint("shuffle_hash")
        # A version removes before it adds, so its own rows stay.
        return rows.join(gone, "source", "left").where(F.col("_gone").isNull() | (F.col("v") >= F.col("_gone"))).drop("_gone")

    def documents(self, version: int | None = None) -> DataFrame:
        """The stored documents, without reading any chunk."""
        live = self._live(version)
        rows = self._rows("documents", f"{DOCUMENT_SCHEMA}, by string, part int", [m.v for m in live])
        return self._kept(rows.where("by = 'source'"), live).select(*_names(DOCUMENT_SCHEMA))

    def documents_with(self, by: str, keys: DataFrame) -> DataFrame:
        """The stored documents with one of the keys: ``by`` is 'hash' or 'source', ``keys`` has that one column.

        Bloom filters tell which parts of which versions may hold a key; only those are read.
        """
        live = self._live()
        column = {"hash": "document_hash", "source": "source"}[by]
        versions = [m.v for m in live]
        if not live:
            return self.spark.createDataFrame([], DOCUMENT_SCHEMA)
        asked = written(keys.select(column).where(F.col(column).isNotNull()).distinct(), "keys")
        parts = self._parts(by, asked.select(F.col(column).alias("key")), live)
        if not parts:
            return self.spark.createDataFrame([], DOCUMENT_SCHEMA)
        rows = self._rows("documents", f"{DOCUMENT_SCHEMA}, by string, part int", versions)
        held = rows.where((F.col("by") == by) & _in_parts(parts)).join(asked, column, "left_semi")
        return self._kept(held, live).select(*_names(DOCUMENT_SCHEMA))

    def _parts(self, by: str, keys: DataFrame, live: list[Row]) -> list[tuple[int, int]]:
        """(v, part) that may hold a key; at most the parts of the live versions reach the driver."""
        whole = [(m.v, 0) for m in live if m.n_documents <= SMALL_VERSION]
        large = [m for m in live if m.n_documents > SMALL_VERSION]
        if not large:
            return whole
        counts = sorted({m.parts for m in large})
        probes = keys.select("key", F.explode(F.array(*map(F.lit, counts))).alias("parts")).select(
            "parts", _part(F.col("key"), F.col("parts")).alias("part"), *_hashes(F.col("key"))
        )
        filters = self._rows("blooms", "bits binary, by string, part int", [m.v for m in large]).where(F.col("by") == by)
        of_version = F.create_map(*[F.lit(x) for m in large for x in (m.v, m.parts)])
        filters = filters.select("v", "part", "bits", F.element_at(of_version, F.col("v")).alias("parts"))
        pairs = probes.groupBy("parts", "part").cogroup(filters.groupBy("parts", "part"))
        return whole + [tuple(r) for r in pairs.applyInArrow(_known, "v int, part int").collect()]

    def status(self) -> DataFrame:
        """(service_name, doc_type, doc_subtype, documents, chunks) of what is stored, from the commits' counts alone."""
        keys = ("service_name", "doc_type", "doc_subtype")
        rows = self._rows("status", STATUS_SCHEMA, [m.v for m in self._live()])
        sums = rows.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"))
        return sums.where("documents > 0")

    def added(self, version: int) -> DataFrame:
        """The rows that one version brought in; reads that version only."""
        if not self._exists(self._path("chunks", version)):
            return self.spark.createDataFrame([], CHUNK_SCHEMA)
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(self._path("chunks", version))

    # ------------------------------------------------------ centres of cells
    def cells(self) -> Cells | None:
        """The centres that stored vectors are placed by, if there are any."""
        path = self._path("cells")
        if not self._exists(path):
            return None
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(path).orderBy("cell").collect()
        return Cells(np.array([r.centre for r in rows]).reshape(len(rows), -1))

    def set_cells(self, cells: Cells) -> None:
        """Once for a store: rows are placed by them from then on."""
        rows = [(k, c.tolist()) for k, c in enumerate(cells.centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("error").parquet(self._path("cells"))

    # -------------------------------------------------------------- writes
    def unlock(self) -> None:
        """Frees the store after a writer died; no other writer may be running."""
        path, system = self._system(self._path("lock"))
        system.delete(path, False)

    def _locked(self, work: Callable[[], int]) -> int:
        path, system = self._system(self._path("lock"))
        system.mkdirs(path.getParent())
        if not system.createNewFile(path):
            raise RuntimeError(f"another job writes to {self.root}; unlock() if it died")
        try:
            if not self._exists(self._path("layout")):
                self.spark.createDataFrame([(self.buckets(),)], "buckets int").coalesce(1).write.mode("overwrite").parquet(self._path("layout"))
            return work()
        finally:
            self.unlock()

    def commit(self, added: DataFrame, removed: DataFrame, txn: str = "") -> int:
        """Removes all chunks of the ``removed`` sources, then adds rows; returns the version.

        Sources that are not stored need not be left out of ``removed``: they are looked up.
        """
        def work() -> int:
            if not self._live():
                return self._write(added, None, 0, [txn], None)
            gone = written(self.documents_with("source", removed), "gone")
            counted = gone.groupBy("service_name", "doc_type", "doc_subtype").agg(
                (-F.count("*")).alias("documents"), (-F.sum("n_chunks")).alias("chunks")
            )
            return self._write(added, gone.select("source").distinct(), gone.count(), [txn], counted)

        return self._locked(work)

    def _write(self, added: DataFrame, removed: DataFrame | None, n_removed: int, txns: list[str], counted: DataFrame | None,
               first: int | None = None) -> int:
        """One version: its rows, then what is derived from them side by side, then its marker.

        ``counted`` are signed counts besides those of the added rows; of a version that stands for
        earlier ones (``first``) they are all there is.
        """
        version = self.version() + 1
        schema = self.spark.createDataFrame([], CHUNK_SCHEMA)
        aligned = schema.unionByName(added, allowMissingColumns=True).select(*schema.columns)
        dealt = aligned.repartition(self.buckets(), "source")  # a file for each bucket and type
        self._write_bucketed(dealt, self._path("chunks", version), ("doc_type",), ("service_name", "source", "chunk_index"))
        keys = [c for c in _names(DOCUMENT_SCHEMA) if c != "n_chunks"]
        sizes = Observation()
        docs = self.added(version).groupBy(*keys).agg(F.count("*").alias("n_chunks")).observe(
            sizes, F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")
        )
        docs = written(docs, "documents")
        n_chunks, n_documents = sizes.get["chunks"], sizes.get["documents"]
        parts = 1 if n_documents <= SMALL_VERSION else min(self.buckets(), 1 + n_documents // PART_DOCUMENTS)
        key = F.when(F.col("by") == "hash", F.col("document_hash")).otherwise(F.col("source"))
        both = docs.withColumn("by", F.explode(F.array(F.lit("hash"), F.lit("source")))).withColumn("_key", key)
        both = both.where("_key is not null").withColumn("part", _part(F.col("_key"), F.lit(parts)))

        def documents() -> None:
            rows = both.drop("_key").repartition("by", "part")
            rows.write.mode("overwrite").partitionBy("by", "part").parquet(self._path("documents", version))

        def blooms() -> None:
            if n_documents <= SMALL_VERSION:
                return
            probes = both.select("by", "part", *_hashes(F.col("_key"))).distinct()
            filters = probes.groupBy("by", "part").applyInArrow(_bloom, "by string, part int, bits binary")
            filters.write.mode("overwrite").partitionBy("by", "part").parquet(self._path("blooms", version))

        def removals() -> None:
            if n_removed:
                few = removed.coalesce(1) if n_removed <= ONE_TASK_REMOVALS else removed.repartition(self.buckets(), "source")
                self._write_bucketed(few, self._path("removed", version), (), ("source",))

        def status() -> None:
            plus = docs.groupBy("service_name", "doc_type", "doc_subtype").agg(
                F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks")
            )
            rows = counted if first else plus if counted is None else plus.unionByName(counted)
            rows.write.mode("overwrite").parquet(self._path("status", version))

        with ThreadPoolExecutor(4) as at_once:
            for done in [at_once.submit(part) for part in (documents, blooms, removals, status)]:
                done.result()
        marker = [(first or version, txns, n_chunks, n_removed, n_documents, parts)]
        self.spark.createDataFrame(marker, MARKER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._path("commits", version))
        return version

    def fold(self, most: int = FOLD_ABOVE) -> int | None:
        """Writes the newest versions as one when more than ``most`` hold the store's rows.

        A version is folded in while it is no larger than those after it together, or as long
        as there are too many; so a row is rewritten about as often as the store doubles.
        The folders of versions that an earlier fold had replaced are deleted, those replaced
        now stay for readers that have begun.  Returns the new version, if there is one.
        """
        def work() -> int:
            live, stale = self._live(), self._stale()
            picked, size = live[:2], sum(m.n_chunks for m in live[:2])
            for m in live[2:]:
                if m.n_chunks > size and len(live) - len(picked) < most:
                    break
                picked.append(m)
                size += m.n_chunks
            versions = [m.v for m in picked]
            counted = self._rows("status", STATUS_SCHEMA, versions).groupBy("service_name", "doc_type", "doc_subtype").agg(
                F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks")
            )
            removed = self._rows("removed", "source string", versions).select("source").distinct()
            txns = _latest(t for m in picked for t in m.txns)
            version = self._write(self._chunks(picked), removed, removed.count(), txns, counted, picked[-1].first)
            for kind in KINDS:
                for v in stale:
                    path, system = self._system(self._path(kind, v))
                    system.delete(path, True)
            return version

        return self._locked(work) if len(self._live()) > most else None

    def _stale(self) -> list[int]:
        live = {m.v for m in self._live()}
        return [m.v for m in self._markers() if m.v not in live]

    def compact(self, target_root: str, prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int | None = None) -> "ChunkStore":
        """The current rows as version 1 of a new store, with as many buckets as it now needs.

        ``prepare`` may add columns on the way, such as cells by new centres.
        """
        fresh = ChunkStore(self.spark, target_root, buckets)
        rows = self.read()
        fresh.commit(prepare(rows) if prepare else rows, rows.select("source").limit(0))
        return fresh


def _in_parts(parts: list[tuple[int, int]]) -> Column:
    """A filter that Spark applies to folders before it reads them."""
    if len(parts) > LISTED_PARTS:
        return F.col("part").isin(sorted({p for _, p in parts}))
    out = F.lit(False)
    for version in sorted({v for v, _ in parts}):
        out = out | ((F.col("v") == version) & F.col("part").isin([p for v, p in parts if v == version]))
    return out


def _latest(txns: Iterable[str]) -> list[str]:
    """Of numbered transactions of one name the last, all others as they are."""
    last: dict[str, int] = {}
    rest = set()
    for txn in txns:
        name, _, number = txn.rpartition(":")
        if name and number.isdigit():
            last[name] = max(last.get(name, 0), int(number))
        elif txn:
            rest.add(txn)
    return sorted(rest) + [f"{name}:{number}" for name, number in sorted(last.items())]
