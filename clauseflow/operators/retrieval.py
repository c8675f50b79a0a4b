"""Filtered nearest neighbours, keyword rerank, dual retrieval, rendering.

The exact pool per question is found without pairing rows: each task multiplies a
block of chunk vectors with the question vectors and passes on only its own best
``pool`` per question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from clauseflow import vocab as V
from clauseflow.functions import names, text as tx
from clauseflow.operators import blocks

# Up to this many vector cells the questions travel to every task, which keeps a pool for each
# of them; two million numbers are 16 MB in each worker.  Beyond it both sides are cut into
# blocks and shuffled; both ways compute every distance alike, so the rows are the same.
BROADCAST_CELLS = 2_000_000
BLOCK_CHUNKS = 100_000
BLOCK_QUESTIONS = 20_000
FEW_BLOCKS = 4  # of one side of a scope, unless they would be larger than the above


# ------------------------------------------------------------------ filters
def by_type(chunks: DataFrame, doc_types: Sequence[str] | None) -> DataFrame:
    return chunks if doc_types is None else chunks.where(F.col("doc_type").isin(*doc_types))


def by_service(chunks: DataFrame, service: str | None) -> DataFrame:
    """One service under any of its spellings; letter case of a known one does not matter."""
    if not service:
        return chunks
    alias = V.SERVICE_ALIASES.get(service.strip().lower())
    spellings = {service, alias, V.SERVICE_ALIASES.get(alias or "")}
    return chunks.where(F.col("service_name").isin(*sorted(n for n in spellings if n)))


def service_scopes(questions: DataFrame) -> DataFrame:
    """(question_id, scope) for every spelling of the question's service.

    A known service is looked up under its canonical name and that name's alias, however
    the question spells it.  A question without a service gets no scope and so sees no
    service's terms.
    """
    asked = F.col("service_name")
    spellings = F.array_distinct(F.concat(
        names.alias_names(names.canonical_name(asked)), names.alias_names(asked)
    ))
    return questions.select("question_id", F.explode(spellings).alias("scope"))


# ------------------------------------------------------- exact nearest pool
def _hit_schema(questions: DataFrame, chunks: DataFrame) -> StructType:
    return StructType([
        StructField("question_id", questions.schema["question_id"].dataType),
        StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        StructField("distance", DoubleType()),
    ])


def _pool_with_sent_questions(questions: DataFrame, chunks: DataFrame, pool: int, schema: StructType) -> DataFrame:
    """One pass over the chunk vectors, which stay where they were read."""
    sent = questions.select("question_id", "scope", "vector").toArrow()
    arrow = to_arrow_schema(schema)
    by_scope: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if len(sent):
        ids, vectors = blocks.ids(sent.column("question_id")), blocks.matrix(sent.column("vector"))
        by_scope = {scope: (ids[at], vectors[at]) for scope, at in blocks.places(sent.column("scope")).items()}
    shared = chunks.sparkSession.sparkContext.broadcast(by_scope)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is kept between batches is ``pool`` ids per question, not vectors.
        best: dict[str, blocks.Hits] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = blocks.ids(batch.column("chunk_id")), blocks.matrix(batch.column("vector"))
            for scope, at in blocks.places(batch.column("scope")).items():
                if scope not in shared.value:
                    continue
                found = blocks.best(shared.value[scope][1], ids[at], vectors[at], pool)
                best[scope] = blocks.cut(blocks.join([best[scope], found]), pool) if scope in best else found
        for scope, hits in best.items():
            yield from blocks.table(shared.value[scope][0], hits, arrow).to_batches()

    wanted = questions.select("scope").distinct()
    narrow = chunks.select("chunk_id", "scope", "vector").join(wanted, "scope", "left_semi")
    return narrow.select("chunk_id", "scope", "vector").mapInArrow(search, schema)


def _block_counts(questions: DataFrame, chunks: DataFrame, block_questions: int, block_chunks: int) -> DataFrame:
    """(scope, _cb, _qb): into how many blocks the chunks and the questions of a scope are cut."""
    def count(rows: str, asked: int, most: int) -> Column:
        grown = F.least(F.ceil(F.col(rows) / FEW_BLOCKS), F.lit(most))
        return F.ceil(F.col(rows) / F.greatest(F.lit(asked), grown)).cast("int")

    return (
        chunks.groupBy("scope").agg(F.count("*").alias("_nc"))
        .join(questions.groupBy("scope").agg(F.count("*").alias("_nq")), "scope")
        .select(
            "scope",
            count("_nc", block_chunks, BLOCK_CHUNKS).alias("_cb"),
            count("_nq", block_questions, BLOCK_QUESTIONS).alias("_qb"),
        )
    )


def _pool_with_blocks(questions: DataFrame, chunks: DataFrame, pool: int, schema: StructType,
                      block_questions: int, block_chunks: int) -> DataFrame:
    """Both sides cut into blocks of bounded size, met by an equi-join on the block.

    A scope with a third of all chunks becomes many blocks, so no group grows with
    the data.  A row goes to every block of the other side: blocks start at the rows asked for
    and grow with the scope up to ``BLOCK_QUESTIONS`` and ``BLOCK_CHUNKS``, so that they stay few.
    """
    arrow = to_arrow_schema(schema)
    sizes = _block_counts(questions, chunks, block_questions, block_chunks)

    def place(df: DataFrame, key: str, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return (
            df.select(key, "scope", "vector").join(sizes, "scope")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_blocks)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
            .drop("_cb", "_qb")
        )

    left = place(questions, "question_id", "_q", "_qb", "_c", "_cb")
    right = place(chunks, "chunk_id", "_c", "_cb", "_q", "_qb")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return blocks.table(np.array([]), None, arrow)
        hits = blocks.best(
            blocks.matrix(asked.column("vector")), blocks.ids(held.column("chunk_id")),
            blocks.matrix(held.column("vector")), pool,
        )
        return blocks.table(blocks.ids(asked.column("question_id")), hits, arrow)

    groups = ("scope", "_q", "_c")
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, schema)


def nearest(
    questions: DataFrame,
    chunks: DataFrame,
    pool: int,
    broadcast_cells: int = BROADCAST_CELLS,
    block_questions: int = BLOCK_QUESTIONS,
    block_chunks: int = BLOCK_CHUNKS,
) -> DataFrame:
    """The ``pool`` nearest chunks of each question within its scopes.

    questions(question_id, scope, vector), chunks(chunk_id, scope, vector); a question
    with several scopes has several rows.  ``distance`` is the squared Euclidean one.
    Rows without a vector or scope are found by no question and find nothing.
    Filters belong before this: a pool that is filtered afterwards is another result.
    """
    schema = _hit_schema(questions, chunks)
    questions = questions.where("scope is not null and vector is not null")
    chunks = chunks.where("scope is not null and vector is not null")
    cells = questions.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    if cells <= broadcast_cells:
        found = _pool_with_sent_questions(questions, chunks, pool, schema)
    else:
        found = _pool_with_blocks(questions, chunks, pool, schema, block_questions, block_chunks)
    return top(found, pool, "distance", "chunk_id")


def top(hits: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows per question with their ``rank``; cut before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return hits.withColumn("rank", place).where(F.col("rank") <= n)


# ------------------------------------------------------------------- rerank
Find = Callable[[DataFrame, DataFrame, int], DataFrame]  # questions, chunks, pool


def with_keyword_bits(chunks: DataFrame, keywords: Iterable[str] = V.DOMAIN_KEYWORDS) -> DataFrame:
    """Adds ``keyword_bits`` of the text, to be stored; questions must use the same keywords."""
    return chunks.withColumn("keyword_bits", tx.keyword_bits(F.col("document"), keywords))


def rerank(pool: DataFrame, questions: DataFrame, chunks: DataFrame, n: int,
           bonus: float = V.KEYWORD_BONUS) -> DataFrame:
    """Hybrid score of the pool and its first ``n`` per question.

    ``pool`` has a ``rank`` by distance.  A row whose distance less the question's largest possible bonus lies
    above the n-th distance cannot be among the first n and goes before anything is
    looked up.  Where both sides carry ``keyword_bits``, the matches are the common
    bits, and text and metadata are fetched for the first n only; else they are counted in the
    texts of the rows left.  Equal scores keep distance order.  One chunk is at most one row in ``pool``
    of each question; no shuffle has a width of its own, so a chunk near to very many
    questions is a skewed join that Spark may split.
    """
    by_bits = "keyword_bits" in questions.columns and "keyword_bits" in chunks.columns
    asked = questions.select("question_id", "keywords", *([F.col("keyword_bits").alias("_bits")] if by_bits else []))
    reach = F.max(F.when(F.col("rank") <= n, F.col("distance"))).over(Window.partitionBy("question_id"))
    left = (
        pool.withColumn("_reach", reach).join(asked, "question_id")
        .where(F.col("distance") - F.size("keywords") * F.lit(bonus) <= F.col("_reach")).drop("rank", "_reach")
    )
    details = chunks.drop("scope", "vector", "keyword_bits", "cell", "cell_distance")
    if by_bits:
        matched = left.join(chunks.select("chunk_id", "keyword_bits"), "chunk_id").withColumn(
            "keyword_match", tx.common_bits(F.col("_bits"), F.col("keyword_bits"))
        ).drop("_bits", "keyword_bits")
    else:
        matched = left.join(details, "chunk_id").withColumn(
            "keyword_match", tx.keyword_matches(F.col("document"), F.col("keywords"))
        )
    scored = matched.drop("keywords").withColumn("score", F.col("distance") - F.col("keyword_match") * F.lit(bonus))
    best = top(scored, n, "score", "distance", "chunk_id")
    return best.join(details, "chunk_id") if by_bits else best


def hybrid_search(questions: DataFrame, scopes: DataFrame, chunks: DataFrame, n: int = 3,
                  pool: int = 15, find: Find = nearest) -> DataFrame:
    """Ranked hits.

    questions(question_id, vector, keywords) has one row per question and
    scopes(question_id, scope) says where to look; chunks also carry ``scope``,
    ``document`` and metadata.  ``find`` makes the pool: ``nearest``, or ``cells.finder``.
    """
    asked = questions.select("question_id", "vector").join(scopes, "question_id")
    return rerank(find(asked, chunks, pool), questions, chunks, n)


def with_query(questions: DataFrame, keywords: Iterable[str] = V.DOMAIN_KEYWORDS) -> DataFrame:
    """Adds the search text, its keywords and their bits to (question, instruction)."""
    return questions.withColumn(
        "query", tx.search_text(F.col("question"), F.col("instruction"))
    ).withColumn("keywords", tx.keywords_in(F.col("query"), keywords)).withColumn(
        "keyword_bits", tx.keyword_bits(F.col("query"), keywords)
    )


def search_terms(questions: DataFrame, chunks: DataFrame, n: int = V.TERMS_HITS, pool: int = V.TERMS_POOL,
                 doc_types: Sequence[str] = ("terms",), find: Find = nearest) -> DataFrame:
    """Hits among the terms of the question's own service, under either spelling."""
    held = by_type(chunks, doc_types).withColumn("scope", F.col("service_name"))
    return hybrid_search(questions, service_scopes(questions), held, n, pool, find)


def search_reference(questions: DataFrame, chunks: DataFrame, n: int = V.REFERENCE_HITS,
                     pool: int = V.REFERENCE_POOL, doc_types: Sequence[str] = V.REFERENCE_TYPES,
                     find: Find = nearest) -> DataFrame:
    """Hits among laws and guidelines, whatever the service."""
    everything = F.lit("reference")
    asked = questions.withColumn("scope", everything)
    held = by_type(chunks, doc_types).withColumn("scope", everything)
    return rerank(find(asked, held, pool), questions, held, n)


def drop_other_services(hits: DataFrame, known: Sequence[str] = V.KNOWN_SERVICE_NAMES,
                        service: str = "asked_service", text: str = "document") -> DataFrame:
    """Drops hits whose text names a known service other than the one asked about."""
    others = [F.col(text).contains(F.lit(k)) & (F.col(service) != F.lit(k)) for k in known]
    named = F.coalesce(F.greatest(*others) if len(others) > 1 else others[0], F.lit(False))
    return hits.where(~named)


# ------------------------------------------------------------------- render
def plain_number(value: Column) -> Column:
    """A number in plain decimal form down to 0.0001 and below 1e16, as it is read by people."""
    size = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when((size >= 1e-4) & (size < 1e16) | (size == 0), plain).otherwise(F.lower(value.cast("string")))


def render(hits: DataFrame, questions: DataFrame, score_format: str | None = None) -> DataFrame:
    """One text block per question; at most the top-n rows of a question are gathered."""
    score = plain_number(F.col("score")) if score_format is None else F.format_string(score_format, "score")
    block = F.concat(
        F.lit("[근거 "), F.col("rank").cast("string"),
        F.lit("]\n내용: "), F.coalesce("document", F.lit("")),
        F.lit("\n문서 유형: "), F.coalesce("doc_type", F.lit("unknown")),
        F.lit("\n서비스명: "), F.coalesce("service_name", F.lit("none")),
        F.lit("\n조항: "), F.coalesce("article", F.lit("unknown")),
        F.lit("\n출처: "), F.coalesce("source", F.lit("unknown")),
        F.lit("\n검색 점수: "), score,
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", tx.strip(block).alias("block"))))
    texts = hits.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["block"]), "\n\n").alias("context")
    )
    return questions.select("question_id").join(texts, "question_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(V.NO_HITS_TEXT))
    )


def preview(hits: DataFrame, chars: int = 250) -> DataFrame:
    """Short form of the hits: the opening of the text, scores to four places."""
    return hits.select(
        "question_id", "rank",
        F.substring("document", 1, chars).alias("text"),
        F.col("doc_type").alias("type"), F.col("service_name").alias("service"),
        F.coalesce("article", F.lit("unknown")).alias("article"), "source",
        F.format_string("DISTANCE: %.4f / KEYWORD_MATCH: %d / SCORE: %.4f",
                        "distance", "keyword_match", "score").alias("scores"),
    )


def reference_context(questions: DataFrame, chunks: DataFrame, n: int = V.REFERENCE_HITS,
                      known: Sequence[str] = V.KNOWN_SERVICE_NAMES,
                      doc_types: Sequence[str] = V.REFERENCE_TYPES, find: Find = nearest) -> DataFrame:
    """Reference hits without other services' examples, ranked anew."""
    hits = search_reference(questions, chunks, n, doc_types=doc_types, find=find).join(
        questions.select("question_id", names.canonical_name(F.col("service_name")).alias("asked_service")), "question_id"
    )
    return top(drop_other_services(hits, known).drop("rank"), n, "score", "distance", "chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, known: Sequence[str] = V.KNOWN_SERVICE_NAMES,
             reference_types: Sequence[str] = V.REFERENCE_TYPES, terms_types: Sequence[str] = ("terms",),
             score_format: str | None = None, find: Find = nearest) -> DataFrame:
    """Both contexts of every question, side by side."""
    terms = render(search_terms(questions, chunks, doc_types=terms_types, find=find), questions, score_format)
    reference = render(
        reference_context(questions, chunks, known=known, doc_types=reference_types, find=find), questions, score_format
    )
    return terms.withColumnRenamed("context", "terms_context").join(
        reference.withColumnRenamed("context", "reference_context"), "question_id"
    )
