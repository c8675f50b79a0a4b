"""Checked queries over filters, nearest neighbours, rerank and rendering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import text as tx, vectors
from clauseflow.operators import cells, mentions, retrieval as R
from clauseflow.plans import shapes as S
from clauseflow.plans.registry import checked, table, texts
from clauseflow.session import scratch_dir, spread, written
from clauseflow.sources.store import ChunkStore

KEYWORDS = ("license", "the on", "queque", "erer", "zu ver", "de la", "that")
REFERENCE = ("de", "fr", "es")
NAMES = ("thth", "queque", "enen", "src1")


def chunks_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their stored vectors: publisher as service, language as type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vec = table(spark, sf_dir, "embeddings")
    # Dealt out after the join: a fraction of the texts has a vector.
    return R.with_keyword_bits(spread(docs.join(vec, docs.doc_id == vec.vec_id)).select(
        F.col("doc_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("text").alias("document"),
        F.col("lang").alias("doc_type"), F.col("source").alias("service_name"),
        F.concat(F.lit("art "), F.col("label").cast("string")).alias("article"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), "label",
    ), KEYWORDS)


def questions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a question about the service of its document."""
    asked = chunks_v(spark, sf_dir).select(
        F.col("chunk_id").alias("question_id"), "vector", "label", "service_name",
        F.col("document").alias("question"), F.lit("").alias("instruction"),
    )
    return R.with_query(asked, KEYWORDS).drop("question", "query", "instruction")


_K = ", ".join(f"'{k}'" for k in KEYWORDS)
CHUNKS_V = """
ch AS (SELECT doc_id AS chunk_id, embedding, text AS document, lang AS doc_type, source AS service_name, label,
              'art ' || label AS article, 'doc-' || doc_id AS source
       FROM documents JOIN embeddings ON vec_id = doc_id)"""
QUESTIONS_V = f"""
qs AS (SELECT chunk_id AS question_id, embedding AS qv, label AS qlabel, service_name AS asked,
              list_filter([{_K}], lambda k: contains(replace(document, ' ', ''), replace(k, ' ', ''))) AS kws FROM ch)"""
_DIST = "list_sum(list_transform(list_zip(qv, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def sql_hits(name: str, on: str, pool: int, n: int) -> str:
    """CTEs to ``name``: pool by distance, then rerank, for question/chunk pairs that satisfy ``on``."""
    return f"""
{name}_d AS (SELECT question_id, asked, kws, ch.*, {_DIST} AS distance FROM qs JOIN ch ON {on}),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS pool_rank
             FROM {name}_d QUALIFY pool_rank <= {pool}),
{name}_m AS (SELECT *, len(list_filter(kws, lambda k: contains(replace(document, ' ', ''), replace(k, ' ', '')))) AS keyword_match FROM {name}_p),
{name}_s AS (SELECT *, distance - keyword_match * 0.15::DOUBLE AS score FROM {name}_m),
{name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, distance, chunk_id) AS rank
           FROM {name}_s QUALIFY rank <= {n})"""


_HITS = "question_id, rank, chunk_id, round(distance, 6) AS distance, keyword_match, round(score, 6) AS score"


def _hits(df: DataFrame) -> DataFrame:
    return df.select(
        "question_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"), "keyword_match",
        F.round("score", 6).alias("score"),
    )


@checked(f"""
WITH {CHUNKS_V}, pairs AS (SELECT a.chunk_id, a.embedding AS qv, b.embedding FROM ch a JOIN ch b ON b.chunk_id = a.chunk_id + 1)
SELECT chunk_id, round({_DIST}, 6) AS distance FROM pairs""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to the next one."""
    left = chunks_v(spark, sf_dir).select("chunk_id", "vector")
    right = left.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("other"))
    return left.join(right, "chunk_id").select(
        "chunk_id", F.round(vectors.squared_distance(F.col("vector"), F.col("other")), 6).alias("distance")
    )


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V},
d AS (SELECT question_id, chunk_id, {_DIST} AS distance FROM qs JOIN ch ON label = qlabel)
SELECT question_id, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
FROM d QUALIFY rank <= 15""")
def nearest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest chunks with the same label, for every question."""
    asked = questions_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    held = chunks_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    return R.nearest(asked, held, 15).withColumn("distance", F.round("distance", 6))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V},
d AS (SELECT question_id, chunk_id, {_DIST} AS distance FROM qs JOIN ch ON label = qlabel)
SELECT question_id, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
FROM d QUALIFY rank <= 15""")
def nearest_pool_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by shuffled blocks, the way taken when the questions are many."""
    asked = questions_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    held = chunks_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    found = R.nearest(asked, held, 15, broadcast_cells=0, block_questions=100, block_chunks=100)
    return found.withColumn("distance", F.round("distance", 6))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V},
d AS (SELECT question_id, chunk_id, {_DIST} AS distance FROM qs JOIN ch ON label = qlabel)
SELECT question_id, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
FROM d QUALIFY rank <= 15""")
def nearest_pool_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by metric cells, the way of a store with indexed vectors."""
    held = chunks_v(spark, sf_dir).select("chunk_id", "vector", F.col("label").cast("string").alias("scope"))
    index = cells.fit_cells(held)
    placed = written(cells.with_cells(held, index), "placed")
    asked = questions_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    return cells.nearest_by_cells(asked, placed, 15, index).withColumn("distance", F.round("distance", 6))


@checked(f"WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', 'label = qlabel', 15, 3)} SELECT {_HITS} FROM h")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered pool, keyword bonus, top three, for every question."""
    asked = questions_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    held = chunks_v(spark, sf_dir).withColumn("scope", F.col("label").cast("string"))
    return _hits(R.rerank(R.nearest(asked, held, 15), asked, held, 3))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', "doc_type IN ('de', 'fr', 'es')", 15, 3)} SELECT {_HITS} FROM h""")
def search_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(R.search_reference(questions_v(spark, sf_dir), chunks_v(spark, sf_dir), doc_types=REFERENCE))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', "doc_type IN ('de', 'fr', 'es')", 15, 3)} SELECT {_HITS} FROM h""")
def search_reference_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some chunks have no cell, as if they had been stored before the centres."""
    held = chunks_v(spark, sf_dir)
    index = cells.fit_cells(held)
    placed = cells.with_cells(held, index)
    old = F.col("chunk_id") % 10 == 0
    placed = placed.withColumns({c: F.when(~old, F.col(c)) for c in ("cell", "cell_distance")})
    found = R.search_reference(
        written(questions_v(spark, sf_dir), "questions"), written(placed, "placed"), doc_types=REFERENCE, find=cells.finder(index)
    )
    return _hits(found)


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', "doc_type = 'en' AND service_name = asked", 20, 6)} SELECT {_HITS} FROM h""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(R.search_terms(questions_v(spark, sf_dir), chunks_v(spark, sf_dir), doc_types=("en",)))


def _spelled(rows: DataFrame, key: str, *spellings: str) -> DataFrame:
    """One service under several spellings, vectors of doubles, every eleventh missing."""
    i = F.col(key)
    return rows.withColumn("service_name", S.pick(spellings, i)).withColumn(
        "vector", F.when(i % 11 != 0, F.col("vector").cast("array<double>"))
    )


_SPELLED = "doc_type = 'en' AND chunk_id % 11 <> 0 AND question_id % 11 <> 0"


@checked(f"WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', _SPELLED, 20, 6)} SELECT {_HITS} FROM h")
def search_terms_by_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service asked for under three spellings and stored under two; rows without vectors stay out."""
    asked = _spelled(questions_v(spark, sf_dir), "question_id", "Netflix", "netflix", "넷플릭스")
    held = _spelled(chunks_v(spark, sf_dir), "chunk_id", "netflix", "넷플릭스")
    return _hits(R.search_terms(asked, held, doc_types=("en",)))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, d AS (SELECT question_id, chunk_id, {_DIST} AS distance FROM qs JOIN ch ON {_SPELLED})
SELECT question_id, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
FROM d QUALIFY rank <= 20""")
def nearest_of_doubles_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the same search by the other plan."""
    asked = _spelled(questions_v(spark, sf_dir), "question_id", "Netflix", "netflix", "넷플릭스")
    held = R.by_type(_spelled(chunks_v(spark, sf_dir), "chunk_id", "netflix", "넷플릭스"), ("en",))
    scopes = asked.drop("scope").join(R.service_scopes(asked), "question_id")
    found = R.nearest(
        scopes, held.withColumn("scope", F.col("service_name")), 20, broadcast_cells=0, block_questions=100, block_chunks=100
    )
    return found.withColumn("distance", F.round("distance", 6))


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('h', "doc_type IN ('de', 'fr', 'es')", 15, 3)},
pairs AS (SELECT question_id, chunk_id, len(kws) AS n_keywords, keyword_match FROM h_m)
SELECT * FROM pairs""")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword counts of every pooled pair, before the cut."""
    asked, held = questions_v(spark, sf_dir), chunks_v(spark, sf_dir)
    everything = F.lit("reference")
    pool = R.nearest(
        asked.withColumn("scope", everything), R.by_type(held, REFERENCE).withColumn("scope", everything), 15
    )
    scored = R.rerank(pool, asked, held, 15)
    return scored.join(asked.select("question_id", F.size("keywords").alias("n_keywords")), "question_id").select(
        "question_id", "chunk_id", "n_keywords", "keyword_match"
    )


@checked(f"""
WITH c AS (SELECT doc_id, lang AS doc_type, {S.sql_pick(S.SERVICES, 'doc_id')} AS service_name FROM documents)
SELECT doc_id FROM c WHERE doc_type IN ('en', 'de') AND service_name IN ('Netflix', '넷플릭스')""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("doc_type"), S.pick(S.SERVICES, F.col("doc_id")).alias("service_name")
    )
    return R.by_service(R.by_type(held, ("en", "de")), "Netflix").select("doc_id")


_STORED = f"""
ch AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, embedding, CASE WHEN doc_id % 5 = 1 THEN text || ' license queque' ELSE text END AS document,
              lang AS doc_type, source AS service_name FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 7 <> 3),
qs AS (SELECT doc_id AS question_id, embedding AS qv, source AS asked,
              list_filter([{_K}], lambda k: contains(replace(text, ' ', ''), replace(k, ' ', ''))) AS kws
       FROM documents JOIN embeddings ON vec_id = doc_id)"""


def searched_store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """chunks_v in three commits: all, replacements of a fifth, removal of a seventh; cells from the first on."""
    rows = chunks_v(spark, sf_dir).withColumn("chunk_id", F.lpad(F.col("chunk_id").cast("string"), 12, "0")).drop("label")
    rows = written(rows.withColumn("document_hash", F.md5("document")), "rows")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    index = cells.fit_cells(rows)
    store.commit(rows, rows.select("source").limit(0))
    store.set_cells(index)
    changed = rows.where(number % 5 == 1).withColumn("document", F.concat("document", F.lit(" license queque")))
    store.commit(cells.with_cells(R.with_keyword_bits(changed, KEYWORDS), store.cells()), changed)
    store.commit(rows.limit(0), rows.where(number % 7 == 3))
    return store


@checked(f"""
WITH {_STORED}, {sql_hits('t', "doc_type = 'en' AND service_name = asked", 20, 6)}, {sql_hits('r', "doc_type IN ('de', 'fr', 'es')", 15, 3)}
SELECT 'terms' AS preset, {_HITS} FROM t UNION ALL SELECT 'reference', {_HITS} FROM r""")
def stored_chunks_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both presets over a store with removals, its vectors found by their cells and reranked by their stored bits."""
    store = searched_store(spark, sf_dir)
    find = cells.finder(store.cells())
    asked = written(questions_v(spark, sf_dir), "questions")
    terms = _hits(R.search_terms(asked, store.read(), doc_types=("en",), find=find))
    reference = _hits(R.search_reference(asked, store.read(), doc_types=REFERENCE, find=find))
    return terms.select(F.lit("terms").alias("preset"), "*").union(reference.select(F.lit("reference"), "*"))


_NAMED = " OR ".join(f"(contains(document, '{n}') AND asked_service <> '{n}')" for n in NAMES)


@checked(f"""
SELECT doc_id FROM (SELECT doc_id, text || ' ' || source AS document, {S.sql_pick(NAMES, 'doc_id')} AS asked_service FROM documents)
WHERE NOT ({_NAMED})""")
def other_services_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(" ", "text", "source").alias("document"), S.pick(NAMES, F.col("doc_id")).alias("asked_service")
    )
    return R.drop_other_services(hits, NAMES).select("doc_id")


_NAME_TABLE = """
words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark),
named AS (SELECT name, row_number() OVER (ORDER BY md5(name)) AS place FROM words WHERE length(name) >= 8),
rows AS (SELECT doc_id, text AS document, (SELECT name FROM named WHERE place = 1 + doc_id % (SELECT count(*) FROM named)) AS asked FROM documents)"""


def _name_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All words of eight letters or more of the benchmark as names; every document asks for one of them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where(F.length("name") >= 8).distinct()
    names = written(words.withColumn("place", F.row_number().over(Window.orderBy(F.md5("name"))).cast("long")), "names")
    turn = 1 + F.col("doc_id") % names.count()
    asked = names.select("place", F.col("name").alias("asked"))
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("document"), turn.alias("place"))
    return names, docs.join(asked, "place").drop("place")


@checked(f"WITH {_NAME_TABLE} SELECT doc_id FROM rows WHERE NOT EXISTS (SELECT 1 FROM named WHERE contains(document, name) AND name <> asked)")
def other_names_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no name but the one asked for, by one automaton over all names."""
    names, docs = _name_table(spark, sf_dir)
    return mentions.drop_rows_naming_others(docs, names, "asked").select("doc_id")


@checked(f"WITH {_NAME_TABLE} SELECT doc_id, (SELECT upper(arg_min(name, place)) FROM named WHERE contains(document, name)) AS shown FROM rows")
def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name, in table order, that each document holds."""
    names, docs = _name_table(spark, sf_dir)
    return mentions.with_first_name(docs, names.withColumn("value", tx.upper_letters(F.col("name"))), "document").select("doc_id", "shown")


def sql_render(hits: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT qs.question_id, coalesce(max(c), '{V.NO_HITS_TEXT}') AS context FROM qs LEFT JOIN (
    SELECT question_id, string_agg({S.sql_strip("'[근거 ' || rank || ']' || chr(10) || '내용: ' || document || chr(10) || '문서 유형: ' || doc_type || chr(10) || '서비스명: ' || service_name || chr(10) || '조항: ' || article || chr(10) || '출처: ' || source || chr(10) || '검색 점수: ' || printf('%.4f', score)")},
           chr(10) || chr(10) ORDER BY rank) AS c FROM {hits} GROUP BY question_id) r ON r.question_id = qs.question_id
  GROUP BY qs.question_id)"""


_OTHERS = " OR ".join(f"(contains(document, '{n}') AND asked <> '{n}')" for n in NAMES)


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('t', "doc_type = 'en' AND service_name = asked", 20, 6)},
{sql_hits('r', "doc_type IN ('de', 'fr', 'es')", 15, 3)},
kept AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM r WHERE NOT ({_OTHERS})),
{sql_render('t', 'tc')}, {sql_render('kept', 'rc')}
SELECT question_id, md5(tc.context) AS terms_context, md5(rc.context) AS reference_context FROM tc JOIN rc USING (question_id)""")
def dual_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rendered contexts of every question."""
    both = R.retrieve(
        written(questions_v(spark, sf_dir), "questions"), chunks_v(spark, sf_dir), known=NAMES, reference_types=REFERENCE,
        terms_types=("en",), score_format="%.4f",
    )
    return both.select(
        "question_id", F.md5("terms_context").alias("terms_context"), F.md5("reference_context").alias("reference_context")
    )


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('t', "doc_type = 'en' AND service_name = asked", 20, 6)}, {sql_render('t', 'tc')}
SELECT question_id, context FROM tc""")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions_v(spark, sf_dir)
    hits = R.search_terms(asked, chunks_v(spark, sf_dir), doc_types=("en",))
    return R.render(hits, asked, "%.4f")


@checked(f"""
WITH {CHUNKS_V}, {QUESTIONS_V}, {sql_hits('t', "doc_type = 'en' AND service_name = asked", 20, 6)}
SELECT question_id, rank, left(document, 250) AS text, doc_type AS type, service_name AS service, article, source,
       printf('DISTANCE: %.4f / KEYWORD_MATCH: %d / SCORE: %.4f', distance, keyword_match, score) AS scores FROM t""")
def hit_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview(R.search_terms(questions_v(spark, sf_dir), chunks_v(spark, sf_dir), doc_types=("en",)))


def letter_counts():
    """A stand-in for a model: counts of a to z, scaled to unit length."""

    def model(texts):
        rows = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    return model


_LETTERS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")


@checked(f"""
SELECT doc_id, CASE WHEN norm = 0 THEN 0 ELSE round(v[1] / norm, 3) END AS share_a, CASE WHEN norm = 0 THEN 0 ELSE round(v[5] / norm, 3) END AS share_e
FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
      FROM (SELECT doc_id, [{_LETTERS}] AS v FROM (SELECT doc_id, lower(text) AS t FROM documents)))""")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding hook with a small stand-in model."""
    embed = vectors.embedder(letter_counts)
    return table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v")).select(
        "doc_id", F.round(F.element_at("v", 1).cast("double"), 3).alias("share_a"),
        F.round(F.element_at("v", 5).cast("double"), 3).alias("share_e"),
    )
