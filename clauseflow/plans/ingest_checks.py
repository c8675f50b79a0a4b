"""Checked queries over sources, sinks, the store and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names, text as tx
from clauseflow.operators import ingest, readiness
from clauseflow.plans import jobs, shapes as S
from clauseflow.plans.registry import checked, table, texts
from clauseflow.plans.text_checks import sql_cascade
from clauseflow.session import scratch_dir, written
from clauseflow.sources import crawl, faq, files, policies, requests
from clauseflow.sources.store import ChunkStore


# --------------------------------------------------------------------- sources
@checked("SELECT source, sum(strlen(text) + 1) AS total_bytes FROM documents GROUP BY source")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "corpus")
    table(spark, sf_dir, "documents").select("text", "source").write.partitionBy("source").text(root)
    found = files.list_files(spark, root).select("path", "length")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(
        F.sum("length").alias("total_bytes")
    )


@checked("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-16"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.decode_text(content)).alias("text_md5"))


_KINDS = tuple(V.CRAWL_SUBTYPES) + ("other",)


def crawl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawl lines; some share a source, lack fields or are cut off."""
    i = F.col("doc_id")
    record = F.to_json(F.struct(
        F.when(i % 5 != 0, F.col("source")).alias("service_name"),
        S.pick(_KINDS, i).alias("document_type"),
        F.when(i % 4 != 0, F.concat(F.lit("Title "), i.cast("string"))).alias("title"),
        F.when(i % 3 != 0, F.concat(F.lit("https://example.com/"), F.floor(i / 2).cast("string"))).alias("source_url"),
        F.when(i % 7 == 0, F.lit("2024-05-01")).alias("revision_date"),
        "text",
    ))
    return table(spark, sf_dir, "documents").select(
        F.when(i % 17 == 16, F.substring(record, 1, 40)).otherwise(record).alias("value"),
        F.concat(F.lit("/crawl/part-"), (i % 10).cast("string"), F.lit(".jsonl")).alias("path"),
        F.struct(F.lit(0).cast("long").alias("_block"), i.alias("row")).alias("position"),
    )


_CRAWL = f"""
crawl AS (
  SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN 'https://example.com/' || doc_id // 2 END, '/crawl/part-' || doc_id % 10 || '.jsonl') AS source,
    CASE WHEN doc_id % 4 <> 0 THEN 'Title ' || doc_id ELSE 'part-' || doc_id % 10 || '.jsonl' END AS source_label,
    CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'unknown' END AS service_name,
    ['terms_of_use', 'privacy_policy', 'refund_policy', 'payment_policy', 'refund_policy', 'unknown'][doc_id % 6 + 1] AS doc_subtype,
    text || CASE WHEN doc_id % 7 = 0 AND NOT contains(text, '2024-05-01') THEN chr(10) || chr(10) || '[개정일: 2024-05-01]' ELSE '' END AS text
  FROM documents WHERE doc_id % 17 <> 16 AND length({S.sql_strip('text')}) >= 200)"""


@checked(f"""
WITH {_CRAWL}
SELECT doc_id AS line, source, source_label, service_name, doc_subtype, 'web_html' AS source_kind, md5(text) AS text_md5 FROM crawl""")
def crawl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.parse_lines(crawl_lines(spark, sf_dir)).select(
        F.col("position.row").alias("line"), "source", "source_label", "service_name", "doc_subtype", "source_kind",
        F.md5("text").alias("text_md5"),
    )


@checked(f"""
WITH {_CRAWL}
SELECT source, arg_max(md5(text), doc_id) AS text_md5 FROM crawl GROUP BY source""")
def last_line_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crawl.last_per_source(crawl.parse_lines(crawl_lines(spark, sf_dir)))
    return docs.select("source", F.md5("text").alias("text_md5"))


@checked("""
SELECT doc_id, ['terms_of_use', 'privacy_policy', 'refund_policy', 'payment_policy', 'refund_policy', 'unknown'][doc_id % 6 + 1] AS doc_subtype
FROM documents""")
def crawl_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.lookup(S.pick(_KINDS, F.col("doc_id")), V.CRAWL_SUBTYPES)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(found, F.lit("unknown")).alias("doc_subtype"))


_CATEGORIES = ("refund_policy", "FAQ", "privacy_policy", "billing")


def faq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a FAQ file: its lines ask, the following lines answer.

    Some files are an object instead of an array, some have an item without an answer.
    """
    i = F.col("doc_id")
    lines = F.col("lines")

    def item(x, n):
        answer = F.coalesce(F.try_element_at(lines, (n + 2).cast("int")), F.lit(" "))
        return F.to_json(F.struct(
            x.alias("question"),
            F.when((i % 13 != 12) | (n > 0), answer).alias("answer"),
            F.when(n % 2 == 0, S.pick(_CATEGORIES, i)).alias("category"),
        ))

    array = F.concat(F.lit("["), F.array_join(F.transform(lines, item), ","), F.lit("]"))
    content = F.when(i % 11 == 10, F.lit('{"question":"q","answer":"a"}')).otherwise(array)
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.withColumn("lines", F.split("text", "\n")).select(
        F.concat(F.lit("/corpus/faq/"), "source", F.lit("/"), i.cast("string"), F.lit(".json")).alias("path"),
        content.alias("text"),
    )


_FAQ = f"""
faq AS (
  SELECT '/corpus/faq/' || source || '/' || doc_id || '.json' AS source, source AS service_name, n - 1 AS chunk_index, ls[n] AS question,
         coalesce(ls[n + 1], ' ') AS answer,
         CASE WHEN (n - 1) % 2 = 0 THEN {S.sql_pick(_CATEGORIES, 'doc_id')} END AS category
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS n FROM
        (SELECT *, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 11 <> 10 AND doc_id % 13 <> 12)))"""


@checked(f"WITH {_FAQ} SELECT source, chunk_index, md5(question) AS q, md5(answer) AS a, category FROM faq")
def faq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = faq.explode_items(faq.parse_files(faq_files(spark, sf_dir)))
    return items.select(
        "source", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("question").alias("q"), F.md5("answer").alias("a"), "category"
    )


_FAQ_CHUNKS = f"""
faq_chunks AS (
  SELECT source, service_name, chunk_index, 'Q: ' || {S.sql_strip('question')} || chr(10) || chr(10) || 'A: ' || {S.sql_strip('answer')} AS document,
    CASE WHEN category IN ('terms_of_use', 'privacy_policy', 'refund_policy', 'payment_policy') THEN category
         ELSE {S.sql_first_label("lower(question || ' ' || answer)", V.DOC_SUBTYPE_KEYWORDS, 'unknown')} END AS doc_subtype
  FROM faq WHERE {S.sql_strip('question')} <> '' AND {S.sql_strip('answer')} <> '')"""


@checked(f"""
WITH {_FAQ}, {_FAQ_CHUNKS}
SELECT source, service_name, chunk_index, md5(document) AS content_hash, doc_subtype,
       sha1(source || '::' || chunk_index || '::' || sha1(document)) AS chunk_id FROM faq_chunks""")
def faq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faq.faq_chunks(faq.explode_items(faq.parse_files(faq_files(spark, sf_dir))))
    return rows.select(
        "source", "service_name", F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash", "doc_subtype", "chunk_id"
    )


@checked("""
SELECT page_id, trim(url) AS url, CASE WHEN page_id % 3 = 2 THEN 'kind' END AS reject_reason
FROM pages WHERE page_id % 5 <> 0""")
def explicit_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    registry = table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(S.pick(("terms", "privacy", "none", "terms", "privacy", "cookies"), i), F.lit("none")).alias("kind"),
        F.when(i % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "url", F.lit("\n"))).alias("url"),
    )
    return requests.explicit_urls(registry).select("page_id", "url", "reject_reason")


@checked("""
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'service_missing' WHEN doc_id % 10 = 8 THEN 'service_too_long'
  WHEN doc_id % 10 = 7 THEN 'service_blank' WHEN doc_id % 3 = 2 THEN 'document_type' WHEN doc_id % 4 = 3 THEN 'suffix'
  WHEN n_chars % 5 = 0 THEN 'empty_file' WHEN n_chars > 5000 THEN 'file_too_large' END AS reject_reason
FROM documents""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    uploads = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(i % 10 == 9, F.lit("")).when(i % 10 == 8, F.repeat(F.col("source"), 60)).when(i % 10 == 7, F.lit("  ")).otherwise(F.col("source")).alias("service_name"),
        F.nullif(S.pick(("terms", "privacy", "law", "terms", "privacy", "none"), i), F.lit("none")).alias("document_type"),
        F.when(i % 8 != 7, F.concat(F.lit("a."), S.pick(("PDF", "txt", "pdf", "docx"), i))).alias("file_name"),
        F.when(F.col("n_chars") % 10 == 0, 0).when(F.col("n_chars") % 10 == 5, None).when(F.col("n_chars") > 5000, V.UPLOAD_MAX_BYTES + 1).otherwise(F.col("n_chars")).alias("n_bytes"),
    )
    return requests.check_uploads(uploads).select("doc_id", "reject_reason")


@checked("""
SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'service_missing' WHEN turn % 7 = 6 THEN 'question_missing'
  WHEN length(text) > 2000 THEN 'question_too_long' END AS reject_reason FROM conversations""")
def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 9 != 0, F.col("role")).alias("service_name"),
        F.when(F.col("turn") % 7 != 6, F.col("text")).alias("question"),
    )
    return requests.check_questions(asked).select("conv_id", "turn", "reject_reason")


@checked("""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'service_blank' WHEN doc_id % 4 = 3 THEN 'doc_type' END AS reject_reason FROM documents""")
def manual_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    inputs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 6 != 0, F.col("source")).otherwise(" ").alias("service_name"),
        S.pick(("law", "guideline", "terms", "faq"), i).alias("doc_type"),
    )
    return requests.check_manual(inputs).select("doc_id", "reject_reason")


@checked("""
SELECT service, kind, max(file_name) AS file_name, count(*) AS policies, min(md5(content)) AS lowest, max(md5(content)) AS highest, sum(length(content)) AS chars
FROM (SELECT 'doc ' || source || '_' || lang AS service, ['terms', 'privacy'][doc_id % 2 + 1] AS kind,
             ['terms.txt', 'privacy.txt'][doc_id % 2 + 1] AS file_name,
             '참조 URL: https://example.com/' || doc_id || chr(10) || chr(10) || text AS content
      FROM documents) GROUP BY service, kind""")
def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: the second write replaces the partitions it touches, and only those."""
    root = scratch_dir(spark, "policies")
    pages = table(spark, sf_dir, "documents").select(
        F.concat(F.lit(" doc "), "source", F.lit(":"), "lang", F.lit(". ")).alias("service_name"),
        S.pick(("terms", "privacy"), F.col("doc_id")).alias("kind"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("final_url"), "text",
    )
    policies.write_policies(pages.withColumn("text", F.lit("old")), root)
    policies.write_policies(pages, root)
    prints = F.md5("content")
    return spark.read.parquet(root).groupBy("service", "kind").agg(
        F.max("file_name").alias("file_name"), F.count("*").alias("policies"),
        F.min(prints).alias("lowest"), F.max(prints).alias("highest"), F.sum(F.length("content")).alias("chars"),
    )


# ---------------------------------------------------------- incremental ingest
def store_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of an earlier run, and a batch with new, changed, repeated and blank ones."""
    i = F.col("doc_id")
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", F.concat(F.lit("/d/"), F.lpad(i.cast("string"), 12, "0")).alias("source"),
        F.concat(F.lit("s"), (F.length("source") % 2).cast("string")).alias("service_name"), "text",
    )
    number = F.substring("source", 4, 12).cast("long")
    stored = written(ingest.hashes(docs.where(i % 10 < 5)), "stored").withColumn(
        "ingest_schema_version", F.when(number % 10 == 2, 4).otherwise(V.INGEST_SCHEMA_VERSION)
    )
    batch = docs.where(i % 10 >= 2).withColumn(
        "text",
        F.when(i % 10 == 4, F.concat("text", F.lit("\nAmended.")))
        .when(i % 50 == 9, F.lit(" \n "))
        .otherwise(F.col("text")),
    ).withColumn("doc_type", F.lit("terms"))
    return stored, batch


_STORE_AND_BATCH = f"""
all_docs AS (SELECT doc_id, '/d/' || lpad(doc_id::VARCHAR, 12, '0') AS source, 's' || length(source) % 2 AS service_name, text FROM documents),
inputs AS (
  SELECT doc_id * 2 AS id, text FROM all_docs WHERE doc_id % 10 < 5
  UNION ALL
  SELECT doc_id * 2 + 1, CASE WHEN doc_id % 10 = 4 THEN text || chr(10) || 'Amended.' WHEN doc_id % 50 = 9 THEN ' ' ELSE text END
  FROM all_docs WHERE doc_id % 10 >= 2),
{S.sql_clean('inputs', 'id')},
stored AS (SELECT source, service_name, {S.sql_hash('body')} AS h, CASE WHEN doc_id % 10 = 2 THEN 4 ELSE 5 END AS ver
           FROM cleaned JOIN all_docs ON cleaned.id = doc_id * 2),
batch AS (SELECT doc_id, source, service_name, body, {S.sql_hash('body')} AS h FROM cleaned JOIN all_docs ON cleaned.id = doc_id * 2 + 1),
judged AS (
  SELECT b.*, CASE WHEN body = '' THEN 'empty'
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.source = b.source AND s.h = b.h AND s.ver = 5) THEN 'unchanged'
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.service_name = b.service_name AND s.h = b.h AND s.source <> b.source) THEN 'duplicate'
    WHEN EXISTS (SELECT 1 FROM batch o WHERE o.service_name = b.service_name AND o.h = b.h AND o.source < b.source
                 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.service_name = b.service_name AND s.h = b.h)) THEN 'duplicate'
    ELSE 'new' END AS outcome
  FROM batch b)"""


def _judged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return ingest.judge(written(ingest.hashes(batch), "hashes"), stored)


@checked(f"WITH {_STORE_AND_BATCH} SELECT source, outcome FROM judged")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = store_and_batch(spark, sf_dir)
    return _judged(stored, batch).select("source", "outcome")


@checked(f"""
WITH {_STORE_AND_BATCH}
SELECT source FROM batch b WHERE EXISTS (SELECT 1 FROM stored s WHERE s.source = b.source AND s.h = b.h AND s.ver = 5)""")
def unchanged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = store_and_batch(spark, sf_dir)
    # Written first: a join on the hash would else hash every text twice, once to see that it is not null.
    return ingest.unchanged(written(ingest.hashes(batch), "hashes"), stored).select("source")


@checked(f"""
WITH {_STORE_AND_BATCH}
SELECT count(*) FILTER (outcome <> 'empty') AS succeeded, count(*) FILTER (outcome = 'empty') AS failed, count(*) AS sources,
       CAST(count(*) FILTER (outcome = 'new') AS BIGINT) AS new_chunks FROM judged""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one chunk per new document, so that the SQL need not chunk."""
    stored, batch = store_and_batch(spark, sf_dir)
    judged = _judged(stored, batch)
    one_each = judged.where(F.col("outcome") == "new").select("source")
    return ingest.summary(ingest.outcomes(judged, one_each))


@checked(f"""
WITH RECURSIVE {_STORE_AND_BATCH},
fresh AS (SELECT doc_id, 'terms' AS doc_type, body AS text, source, service_name, h FROM judged WHERE outcome = 'new'),
{sql_cascade('fresh', 'doc_id', 'text')},
parts AS (SELECT id, unnest(chunks) AS part, generate_subscripts(chunks, 1) - 1 AS n FROM chunked)
SELECT source, service_name, h AS document_hash, n AS chunk_index, sha1(source || '::' || n || '::' || sha1(part)) AS chunk_id
FROM parts JOIN fresh ON id = doc_id""")
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole batch: clean, hash, judge against the store, chunk what is new.

    Most of the batch is new, so its cleaned texts are written once and not cleaned again.
    """
    stored, batch = store_and_batch(spark, sf_dir)
    docs = written(ingest.prepare(batch.drop("doc_id")).drop("scope"), "prepared")
    narrow = written(ingest.hashes_of_prepared(docs), "hashes")
    new = ingest.judge(narrow, stored).where(F.col("outcome") == "new").select("source")
    return ingest.chunk_rows(docs.join(new, "source", "left_semi")).select(
        "source", "service_name", "document_hash", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id"
    )


def _store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a store: a conversation is a source, a turn is a chunk."""
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("src-"), c.cast("string")).alias("source"),
        F.concat(F.lit("src-"), c.cast("string"), F.lit("#"), F.col("turn").cast("string")).alias("chunk_id"),
        F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("document"),
        S.pick(("terms", "law", "guideline", "faq", "terms"), c).alias("doc_type"),
        S.pick(tuple(V.DOC_SUBTYPE_KEYWORDS), c).alias("doc_subtype"),
        S.pick(("tving", "티빙", "Netflix", "무명", "src"), F.floor(c / 2)).alias("service_name"),
        S.pick(("file", "url", "file"), c).alias("source_kind"),
    )


_STORE_ROWS = f"""
store AS (
  SELECT 'src-' || conv_id AS source, 'src-' || conv_id || '#' || turn AS chunk_id, turn, conv_id, text AS document,
    {S.sql_pick(('terms', 'law', 'guideline', 'faq', 'terms'), 'conv_id')} AS doc_type,
    {S.sql_pick(tuple(V.DOC_SUBTYPE_KEYWORDS), 'conv_id')} AS doc_subtype,
    {S.sql_pick(('tving', '티빙', 'Netflix', '무명', 'src'), 'conv_id // 2')} AS service_name,
    {S.sql_pick(('file', 'url', 'file'), 'conv_id')} AS source_kind
  FROM conversations)"""


@checked(f"""
WITH {_STORE_ROWS}
SELECT chunk_id, md5(document) AS content FROM store WHERE conv_id % 3 <> 0
UNION ALL SELECT chunk_id || 'n', md5(document || '!') FROM store WHERE conv_id % 3 = 0 AND turn < 3""")
def upserted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store_rows(spark, sf_dir)
    changed = store.where(F.regexp_extract("source", r"(\d+)", 1).cast("long") % 3 == 0)
    new = changed.where("chunk_index < 3").select(
        "source", F.concat("chunk_id", F.lit("n")).alias("chunk_id"), F.concat("document", F.lit("!")).alias("document")
    )
    return ingest.upsert(store, new, changed).select("chunk_id", F.md5("document").alias("content"))


@checked(f"""
WITH {_FAQ}, {_FAQ_CHUNKS},
old AS (SELECT DISTINCT source FROM faq)
SELECT source || '#old' AS chunk_id, 'old' AS content FROM (SELECT DISTINCT source || 'x' AS source FROM faq)
UNION ALL
SELECT sha1(source || '::' || chunk_index || '::' || sha1(document)), md5(document) FROM faq_chunks""")
def upserted_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows of every FAQ file give way to its items; rows of other sources stay."""
    items = faq.explode_items(faq.parse_files(faq_files(spark, sf_dir)))
    read = items.select("source").distinct()
    stored = read.unionByName(read.withColumn("source", F.concat("source", F.lit("x")))).select(
        "source", F.concat("source", F.lit("#old")).alias("chunk_id"), F.lit("old").alias("content_hash")
    )
    return ingest.upsert(stored, faq.faq_chunks(items), read).select("chunk_id", F.col("content_hash").alias("content"))


@checked(f"WITH {_STORE_ROWS} SELECT chunk_id FROM store WHERE source_kind <> 'file' OR conv_id % 2 = 0")
def swept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select(
        F.concat(F.lit("src-"), F.col("conv_id").cast("string")).alias("source")
    )
    return ingest.sweep(_store_rows(spark, sf_dir), current).select("chunk_id")


@checked(f"""
WITH {_STORE_ROWS}, asked AS (SELECT DISTINCT source AS service_name FROM documents UNION SELECT DISTINCT service_name FROM store)
SELECT service_name FROM asked WHERE service_name IN (SELECT service_name FROM store WHERE doc_type = 'terms' AND doc_subtype = 'privacy_policy')""")
def existing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store_rows(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("service_name")).union(
        store.select("service_name")
    ).distinct()
    return ingest.documents_exist(asked, store, "privacy_policy")


@checked(f"""
WITH {_STORE_ROWS}
SELECT chunk_id, md5(document) AS content FROM store WHERE conv_id % 4 <> 1
UNION ALL SELECT chunk_id, md5(document || '!') FROM store WHERE conv_id % 4 = 1 AND conv_id % 8 <> 1""")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits: all rows, replacements of some sources, removal of others."""
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    rows = _store_rows(spark, sf_dir)
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    store.commit(rows, rows.select("source").limit(0))
    changed = rows.where(number % 4 == 1).withColumn("document", F.concat("document", F.lit("!")))
    store.commit(changed, changed)
    store.commit(rows.limit(0), rows.where(number % 8 == 1))
    return store.read().select("chunk_id", F.md5("document").alias("content"))


@checked(f"""
WITH {_STORE_ROWS},
changed AS (SELECT source, doc_type, 'privacy_policy' AS doc_subtype, service_name, source_kind, conv_id FROM store WHERE conv_id % 4 = 1),
all_rows AS (SELECT source, doc_type, doc_subtype, service_name, source_kind, conv_id FROM store WHERE conv_id % 4 <> 1 UNION ALL FROM changed
             UNION ALL SELECT 'faq-' || conv_id, 'faq', 'unknown', 'none', 'file', 0 FROM store WHERE conv_id % 5 = 2 AND conv_id % 2 = 1),
held AS (SELECT * EXCLUDE (service_name), CASE service_name WHEN 'tving' THEN '티빙' WHEN 'Netflix' THEN '넷플릭스' ELSE service_name END AS svc
         FROM all_rows WHERE source_kind <> 'file' OR conv_id % 3 = 0 OR source LIKE 'faq-%'),
asked AS (SELECT DISTINCT svc FROM held UNION SELECT source FROM documents)
SELECT a.svc AS service_name, coalesce(bool_or(doc_type = 'terms' AND doc_subtype = 'terms_of_use'), false) AS has_terms,
       coalesce(bool_or(doc_type = 'terms' AND doc_subtype = 'privacy_policy'), false) AS has_privacy,
       (SELECT coalesce(bool_or(doc_type = 'law') AND bool_or(doc_type = 'guideline'), false) FROM held) AS reference_ready,
       count(DISTINCT source) AS documents, count(source) AS chunks
FROM asked a LEFT JOIN held h ON h.svc = a.svc GROUP BY a.svc""")
def stored_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness and counts from what commits, replacements, a sweep and FAQ rows left of the counts; no document is read."""
    # One hash a source: a document is one row however many chunks it has.
    rows = written(_store_rows(spark, sf_dir).withColumn("document_hash", F.md5("source")), "rows")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    store.commit(rows, rows.select("source").limit(0))
    changed = rows.where(number % 4 == 1).withColumn("doc_subtype", F.lit("privacy_policy"))
    store.commit(changed, changed)
    listed = rows.where(number % 3 == 0).select(F.col("source").alias("path"))
    jobs.sweep_files(store, listed)
    faq_rows = rows.where((number % 5 == 2) & (number % 2 == 1)).select(
        F.concat(F.lit("faq-"), number.cast("string")).alias("source"), "chunk_id", F.lit("faq").alias("doc_type"),
        F.lit("unknown").alias("doc_subtype"), F.lit("none").alias("service_name"), F.lit("file").alias("source_kind"),
    )
    store.commit(faq_rows, faq_rows)
    status = store.status()
    asked = status.select("service_name").union(table(spark, sf_dir, "documents").select("source"))
    ready = readiness.readiness(asked, status).select("service_name", "has_terms", "has_privacy", "reference_ready")
    counts = status.groupBy(names.canonical_name(F.col("service_name")).alias("service_name")).agg(
        F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks")
    )
    return ready.join(counts, "service_name", "left").na.fill(0, ["documents", "chunks"])


@checked("""
SELECT doc_id, count(*) AS pages, count(*) FILTER (blank) AS blank_pages,
       count(*) FILTER (blank) = count(*) OR count(*) FILTER (blank) / count(*) > 0.7 AS needs_ocr
FROM (SELECT conv_id AS doc_id, conv_id % 5 + turn % 6 > 3 AS blank FROM conversations) GROUP BY doc_id""")
def ocr_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.col("conv_id") % 5 + F.col("turn") % 6 > 3
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.when(~blank, F.col("text")).when(F.col("turn") % 2 == 0, F.lit(" \n")).alias("text")
    )
    return ingest.needs_ocr(pages)


@checked("""
WITH p AS (SELECT conv_id AS doc_id, turn, text, conv_id % 5 + turn % 6 > 3 AS blank FROM conversations),
d AS (SELECT doc_id, count(*) FILTER (blank) / count(*) > 0.7 AS ocr, string_agg(text || chr(10), '' ORDER BY turn) FILTER (NOT blank) AS layer,
        string_agg(text || '!' || chr(10), '' ORDER BY turn) AS seen FROM p GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN NOT ocr THEN layer WHEN length(trim(seen, ' ' || chr(10))) >= 100
        AND length(regexp_replace(seen, '[^a-m]', '', 'g')) / length(seen) >= 0.4 THEN seen END AS text FROM d)
SELECT doc_id, md5(text) AS text, CASE WHEN text IS NULL THEN 'unreadable' END AS reject_reason FROM t""")
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page rows; recognition adds a mark, and fails where few letters are from a to m."""
    blank = F.col("conv_id") % 5 + F.col("turn") % 6 > 3
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text", blank.alias("blank"))
    pages = rows.withColumn("text", F.when(~F.col("blank"), F.col("text")).when(F.col("page_no") % 2 == 0, F.lit(" \n")))
    seen = rows.withColumn("text", F.concat("text", F.lit("!")))
    found = ingest.paged_documents(pages, seen, script="[a-m]", min_share=0.4)
    return found.select("doc_id", F.md5("text").alias("text"), "reject_reason")


# ------------------------------------------------------------------- readiness
@checked(f"""
WITH {_STORE_ROWS}, canon AS (SELECT *, CASE service_name WHEN 'tving' THEN '티빙' WHEN 'Netflix' THEN '넷플릭스' ELSE service_name END AS svc FROM store)
SELECT svc AS service_name, bool_or(doc_subtype = 'terms_of_use') AS has_terms, bool_or(doc_subtype = 'privacy_policy') AS has_privacy
FROM canon WHERE doc_type = 'terms' GROUP BY svc""")
def policy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.policy_status(_store_rows(spark, sf_dir))


@checked(f"""
WITH {_STORE_ROWS}, canon AS (SELECT *, CASE service_name WHEN 'tving' THEN '티빙' WHEN 'Netflix' THEN '넷플릭스' ELSE service_name END AS svc FROM store),
asked AS (SELECT DISTINCT svc FROM canon UNION SELECT source FROM documents),
status AS (SELECT asked.svc, coalesce(bool_or(doc_type = 'terms' AND doc_subtype = 'terms_of_use'), false) AS t,
                  coalesce(bool_or(doc_type = 'terms' AND doc_subtype = 'privacy_policy'), false) AS p
           FROM asked LEFT JOIN canon ON asked.svc = canon.svc GROUP BY asked.svc)
SELECT svc AS service_name, t AS has_terms, p AS has_privacy,
       concat_ws(',', CASE WHEN NOT t THEN 'terms' END, CASE WHEN NOT p THEN 'privacy' END) AS missing,
       NOT (t AND p) AS requires_input, t OR p AS service_ready,
       (SELECT bool_or(doc_type = 'law') AND bool_or(doc_type = 'guideline') FROM store) AS reference_ready
FROM status""")
def readiness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store_rows(spark, sf_dir)
    asked = store.select("service_name").union(table(spark, sf_dir, "documents").select("source"))
    return readiness.readiness(asked, store).withColumn("missing", F.array_join("missing", ","))


@checked(f"WITH {_STORE_ROWS} SELECT bool_or(doc_type = 'law') AND bool_or(doc_type = 'guideline') AS reference_ready FROM store")
def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.reference_status(_store_rows(spark, sf_dir))


@checked(f"""
WITH asked AS (SELECT DISTINCT trim({S.sql_pick(S.SERVICES, 'doc_id')}) AS s FROM documents),
c AS (SELECT s, CASE lower(s) WHEN 'netflix' THEN '넷플릭스' WHEN 'tving' THEN '티빙' WHEN 'youtube' THEN '유튜브' ELSE s END AS canon FROM asked)
SELECT a.s AS service_name, b.s AS folder FROM c a JOIN c b USING (canon)""")
def matching_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(
        tx.strip(S.pick(S.SERVICES, F.col("doc_id"))).alias("service_name")
    ).distinct()
    return readiness.matching_folders(asked, asked.withColumnRenamed("service_name", "folder")).select("service_name", "folder")


@checked("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return readiness.first_occurrences(rows, ["text_md5"], "doc_id")


@checked("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'privacy,terms' WHEN 1 THEN 'terms' WHEN 2 THEN 'privacy' ELSE 'terms,privacy' END AS requested,
       CASE doc_id % 4 WHEN 0 THEN 'terms,privacy' WHEN 1 THEN 'terms' WHEN 2 THEN 'privacy' ELSE '' END AS missing
FROM documents""")
def requested_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    explicit = (
        F.when(i == 0, F.array(F.lit("privacy"))).when(i == 3, F.array(F.lit("terms"), F.lit("privacy"), F.lit("terms")))
        .otherwise(F.array().cast("array<string>"))
    )
    flagged = table(spark, sf_dir, "documents").select(
        "doc_id", explicit.alias("explicit"), i.isin(2, 3).alias("has_terms"), i.isin(1, 3).alias("has_privacy")
    ).withColumn("missing", readiness.missing_kinds())
    return flagged.select(
        "doc_id", F.array_join(readiness.requested_kinds(F.col("explicit"), F.col("missing")), ",").alias("requested"),
        F.array_join("missing", ",").alias("missing"),
    )


@checked(f"""
WITH {_STORE_AND_BATCH}
SELECT service_name, count(*) FILTER (outcome <> 'empty') AS succeeded FROM judged GROUP BY service_name""")
def local_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = store_and_batch(spark, sf_dir)
    judged = _judged(stored, batch).withColumn(
        "outcome", F.when(F.col("outcome") == "new", "done").otherwise(F.col("outcome"))
    )
    return readiness.local_successes(judged)
