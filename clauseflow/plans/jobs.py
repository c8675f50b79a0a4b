"""The whole jobs: ingest, sweep, page collection, readiness, questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names, paths, text as tx
from clauseflow.operators import answers, cells, history, ingest, readiness, retrieval, runs, selection
from clauseflow.session import written
from clauseflow.sources import crawl, faq, files, policies, requests
from clauseflow.sources.store import ChunkStore


Embed = Callable[[Column], Column]


def _searchable(store: ChunkStore, chunks: DataFrame, embed: Embed | None) -> DataFrame:
    """Chunks with what a search reads beside their text: keyword bits, and with a model vector and cell."""
    chunks = retrieval.with_keyword_bits(chunks)
    if embed is None:
        return chunks
    index = store.cells()
    chunks = chunks.withColumn("vector", embed(F.col("document")))
    return chunks if index is None else cells.with_cells(chunks, index)


def ingest_documents(
    store: ChunkStore, docs: DataFrame, txn: str = "", mode: str = "recursive", embed: Embed | None = None
) -> DataFrame:
    """Cleans, judges, chunks and commits a batch; returns the outcome of every source.

    docs(source, source_label, doc_type, service_name, doc_subtype, source_kind, text),
    one row per source, and ``position`` where equal texts are taken in another order
    than that of their sources.  Texts are read twice: once for the hash of each document, and
    once, for the new ones only, to be chunked.  Between the two lies a written table
    of narrow rows.
    """
    docs = docs.withColumn("service_name", F.coalesce("service_name", F.lit("unknown")))
    narrow = written(ingest.hashes(docs), "hashes")
    # Both tests of a source ask for its hash, so only documents with a hash of the batch are read.
    stored = written(ingest.stored_documents(store.documents_with("hash", narrow)), "stored")
    judged = written(ingest.judge(narrow, stored), "judged")
    new = judged.where(F.col("outcome") == "new").select("source")
    chunks = ingest.chunk_rows(ingest.prepare(docs.drop("position").join(new, "source", "left_semi")), mode)
    version = store.commit(_searchable(store, chunks, embed), new, txn)
    return ingest.outcomes(judged, store.added(version).select("source"))


def ingest_crawl(store: ChunkStore, lines: DataFrame, txn: str = "", embed: Embed | None = None) -> DataFrame:
    """Crawl lines (path, value, position), parsed once and written, then ingested in their order."""
    docs = crawl.last_per_source(written(crawl.parse_lines(lines), "crawled"))
    return ingest_documents(store, docs, txn, embed=embed)


def ingest_faq(store: ChunkStore, faq_files: DataFrame, txn: str = "", embed: Embed | None = None) -> DataFrame:
    """Replaces the chunks of every readable FAQ file (path, text); returns file outcomes."""
    parsed = written(faq.parse_files(faq_files), "faq")
    readable = parsed.where(F.col("items").isNotNull())
    chunks = faq.faq_chunks(faq.explode_items(readable)).withColumn("updated_at", F.current_timestamp())
    store.commit(_searchable(store, chunks, embed), readable.select(F.col("path").alias("source")), txn)
    return parsed.select(
        F.col("path").alias("source"),
        F.when(F.col("items").isNotNull(), "done").otherwise("rejected").alias("outcome"),
    )


def sweep_files(store: ChunkStore, *listings: DataFrame) -> int:
    """Removes chunks of files that are listed under none of the roots; returns the version.

    Give the listings of all roots that feed the store: a root left out counts as gone.
    """
    current = listings[0].select("path")
    for more in listings[1:]:
        current = current.union(more.select("path"))
    stale = ingest.stale_sources(store.documents(), current.withColumnRenamed("path", "source"))
    return store.commit(store.read().limit(0), written(stale, "stale"))


def _in_path_order(path: Column) -> Column:
    """A position before all lines of the file; a path has one form, however Spark wrote its scheme."""
    return F.struct(path.alias("path"), F.lit(-1).cast("long").alias("_block"), F.lit(0).cast("long").alias("row"))


def _one_form(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-zA-Z0-9+.-]+:)/+(?=[^/])", "$1/")


def ingest_folder(
    store: ChunkStore, root: str, *other_roots: str, embed: Embed | None = None,
    pages: DataFrame | None = None, recognised: DataFrame | None = None,
) -> DataFrame:
    """Everything below ``root``, then a sweep; returns one row of counts over files.

    Texts, crawl lines and paged files are one batch in the order of their paths (lines in
    that of their file), so of equal texts the first file wins whatever its kind.  The files
    of page documents are not parsed here: ``pages`` and ``recognised`` are (path, page_no, text)
    rows of their text layer and of what recognition saw.  A paged file without readable text
    has failed, as has one that has no rows at all.
    """
    spark = store.spark
    texts = files.read_documents(spark, root)
    paged = files.list_files(spark, root, ("pdf",)).select("path")
    if pages is not None:
        rows = [p.withColumn("doc_id", _one_form(F.col("path"))) for p in (pages, pages.limit(0) if recognised is None else recognised)]
        read = ingest.paged_documents(*rows).select(F.col("doc_id").alias("_form"), "text")
        found = paged.withColumn("_form", _one_form(F.col("path"))).join(read, "_form", "left").drop("_form")
        # A file without text goes in as an empty one, which is a failure.
        texts = texts.unionByName(files.with_path_metadata(found).withColumn("source", F.col("path")))
    texts = texts.withColumn("position", _in_path_order(_one_form(F.col("path")))).drop("path")
    lines = crawl.read_lines(spark, root)
    parsed = written(crawl.parse_lines(lines), "crawled")
    place = F.col("position").withField("path", _one_form(F.col("position.path")))
    crawled = crawl.last_per_source(parsed).withColumn("position", place)
    judged = ingest_documents(store, texts.unionByName(crawled), embed=embed)
    good = F.col("outcome").isin("done", "unchanged", "duplicate")
    well = judged.where(good).select("source")
    # A crawl file succeeds if any of its lines does.
    of_file = parsed.select("source", F.col("position.path").alias("path")).distinct().join(well, "source", "left_semi")
    listed = files.list_files(spark, root, ("txt", "pdf")).select(F.col("path").alias("source"), "path").union(
        lines.select(F.lit(None).cast("string"), "path").distinct()
    )
    succeeded = well.select(F.col("source").alias("path")).union(of_file.select("path")).distinct().withColumn("good", F.lit(True))
    of_texts = listed.join(succeeded, "path", "left").select(F.coalesce("good", F.lit(False)).alias("good"))
    faqs = ingest_faq(store, files.list_files(spark, root, ("json",)).select(
        "path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text")
    ), embed=embed)
    sweep_files(store, *[files.list_files(spark, r) for r in (root, *other_roots)])
    counts = of_texts.union(faqs.select(good.alias("good"))).agg(
        F.count_if("good").alias("succeeded"), F.count_if(~F.col("good")).alias("failed"), F.count("*").alias("sources"),
    )
    chunks = store.status().agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return counts.withColumn("chunks", chunks.scalar())


def _one_per_source(docs: DataFrame) -> DataFrame:
    """Equal ids mean equal text up to white space; the choice among them is fixed."""
    rest = [c for c in docs.columns if c not in ("source", "text")]
    kept = docs.groupBy("source").agg(F.max(F.struct("text", *rest)).alias("_r"))
    return kept.select("source", "_r.*")


def pasted_documents(pasted: DataFrame) -> DataFrame:
    """Pasted texts (service_name, text, doc_type, doc_subtype) that pass the checks, as source documents."""
    pasted = requests.accepted(requests.check_manual(pasted))
    service = tx.strip(F.col("service_name"))
    return _one_per_source(pasted.select(
        tx.pasted_source_id(service, F.col("text")).alias("source"),
        F.concat(service, F.lit(V.PASTED_LABEL)).alias("source_label"),
        "doc_type", service.alias("service_name"), "doc_subtype", F.lit("pasted").alias("source_kind"), "text",
    ))


def uploaded_documents(uploads: DataFrame) -> DataFrame:
    """Accepted uploads (service_name, file_name, text, doc_type, doc_subtype) as source documents.

    Services go under their canonical name; a missing subtype is read off the file name.
    """
    service, name = names.canonical_name(F.col("service_name")), F.col("file_name")
    return _one_per_source(uploads.select(
        tx.upload_source_id(service, name, F.col("text")).alias("source"),
        name.alias("source_label"), "doc_type", service.alias("service_name"),
        paths.upload_subtype(name, F.col("doc_subtype"), F.col("doc_type")).alias("doc_subtype"),
        F.lit("upload").alias("source_kind"), "text",
    ))


def upload_batch(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads (service_name, document_type, file_name, n_bytes, text) as source documents, and the rejected rows.

    The document type is the policy kind that the user names; the text is what was read from the file.
    """
    checked = requests.check_uploads(uploads)
    kind = tx.lookup(F.col("document_type"), V.POLICY_SUBTYPES)
    docs = requests.accepted(checked).withColumn("doc_type", F.lit("terms")).withColumn("doc_subtype", kind)
    return uploaded_documents(docs), checked.where(F.col("reject_reason").isNotNull())


def url_documents(extracted: DataFrame) -> DataFrame:
    """Texts of user URLs (service_name, url, text, doc_type, doc_subtype) that pass the checks, one row per URL."""
    extracted = requests.accepted(requests.check_manual(extracted))
    return extracted.select(
        F.col("url").alias("source"), F.col("url").alias("source_label"), "doc_type",
        tx.strip(F.col("service_name")).alias("service_name"), "doc_subtype",
        F.lit("url").alias("source_kind"), "text",
    )


def collect_policies(
    candidates: DataFrame, pages: DataFrame, root: str,
    keywords: Mapping[str, Iterable[str]] = V.POLICY_KEYWORDS, min_chars: int = V.MIN_BODY_CHARS,
) -> DataFrame:
    """Chooses a page per service and kind, writes the policy files, returns the choice."""
    chosen = written(selection.choose_pages(candidates, pages, keywords, min_chars=min_chars), "chosen")
    policies.write_policies(chosen, root)
    return chosen


def services_status(store: ChunkStore, services: DataFrame) -> DataFrame:
    """Readiness of every asked service, from the counts that commits keep; no document is read."""
    return readiness.readiness(services, store.status())


def prepare_services(
    store: ChunkStore, services: DataFrame, candidates: DataFrame, pages: DataFrame, root: str,
    local: DataFrame | None = None, reference: DataFrame | None = None,
    keywords: Mapping[str, Iterable[str]] = V.POLICY_KEYWORDS, min_chars: int = V.MIN_BODY_CHARS,
    embed: Embed | None = None,
) -> DataFrame:
    """Brings the store up to what the asked services need; returns their readiness.

    services(service_name); candidates and pages as for ``selection.choose_pages``, explicit
    URLs among them with their priority; ``local`` and ``reference`` are source documents
    of service folders and of laws and guidelines.  Reference data is taken if a kind of
    it is missing, folders of services that lack a policy are taken next, and pages are
    chosen for explicit URLs and for what is missing then.
    """
    asked = services.select(names.canonical_name(F.col("service_name")).alias("service_name")).distinct()
    if reference is not None and not readiness.reference_status(store.status()).first()[0]:
        ingest_documents(store, reference, embed=embed)
    short = written(services_status(store, asked).where("requires_input").select("service_name"), "short")
    if local is not None:
        folders = local.withColumn("_canonical", names.canonical_name(F.col("service_name")))
        own = folders.join(short.withColumnRenamed("service_name", "_canonical"), "_canonical", "left_semi")
        ingest_documents(store, own.drop("_canonical"), embed=embed)
    missing = services_status(store, asked).select("service_name", F.explode("missing").alias("kind"))
    known = candidates.withColumn("service_name", names.canonical_name(F.col("service_name")))
    explicit = known.where(F.col("priority") == selection.EXPLICIT).select("service_name", "kind")
    wanted = missing.union(explicit.join(asked, "service_name", "left_semi")).distinct()
    chosen = collect_policies(
        known.join(written(wanted, "wanted"), ["service_name", "kind"], "left_semi"), pages, root, keywords, min_chars
    )
    # Only the files of this run: those of other services are where they were.
    places = chosen.select(names.folder_name(F.col("service_name")).alias("service_name"), "kind").distinct()
    collected = policies.read_policies(store.spark, root).join(places, ["service_name", "kind"], "left_semi")
    if chosen.limit(1).count():
        ingest_documents(store, collected.drop("kind"), embed=embed)
    return services_status(store, asked)


def finish_runs(
    questions: DataFrame, verdicts: DataFrame, raw_answers: DataFrame, hits: DataFrame,
    items: DataFrame, asked_before: DataFrame, max_retries: int = V.MAX_RETRIES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer runs from their logs into the history: (items, questions, problems).

    questions(run_id, item_id, qa_id, seq, question, in_scope), verdicts(run_id, ts, seq,
    status, action), raw_answers(run_id, answer), hits(run_id, document).  Runs that end in
    a passed answer are parsed and become question rows, with the share of their evidence
    that a hit holds; runs out of scope become rows with the fixed message.  ``problems``
    has a row per run that did not end well and per answer without full grounding.
    """
    ended = written(runs.replay(questions.select("run_id", "in_scope"), verdicts, max_retries), "ended")
    passed = ended.where(F.col("final_node") == "generate_final_answer").select("run_id")
    parsed = answers.parse_answers(raw_answers.join(passed, "run_id", "left_semi"))
    outside = runs.out_of_scope_answers(questions.select("run_id", "in_scope")).select(
        "run_id", F.to_json(F.struct("message")).alias("answer")
    )
    said = written(parsed.unionByName(answers.parse_answers(outside)), "answers")
    rows = answers.history_rows(said.join(questions.select("run_id", "item_id", "qa_id", "seq", "question"), "run_id"))
    rows = rows.join(questions.select("qa_id", "seq"), "qa_id")
    sentences = said.select("run_id", F.posexplode("terms_evidence").alias("sentence_no", "sentence"))
    share = answers.grounded_share(answers.grounding(sentences, hits))
    problems = ended.where(~F.col("final_node").isin("generate_final_answer", "generate_out_of_scope_answer")).select(
        "run_id", F.col("final_node").alias("problem")
    ).union(share.where("grounded < sentences").select("run_id", F.lit("ungrounded")))
    return *history.append_questions(items, asked_before, rows), problems


def index_vectors(store: ChunkStore, k: int | None = None) -> None:
    """Fits the cells of a store to what it holds; chunks stored from now on carry theirs."""
    store.set_cells(cells.fit_cells(store.read(), k))


def compact(store: ChunkStore, target_root: str, k: int | None = None, buckets: int | None = None) -> ChunkStore:
    """The store's current rows in a new one, with cells fitted to all of them if the old one had any."""
    if store.cells() is None:
        return store.compact(target_root, buckets=buckets)
    index = cells.fit_cells(store.read(), k)
    fresh = store.compact(target_root, lambda rows: cells.with_cells(rows.drop("cell", "cell_distance"), index), buckets)
    fresh.set_cells(index)
    return fresh


def answer_contexts(store: ChunkStore, questions: DataFrame, embed: Embed) -> DataFrame:
    """Both contexts for questions(question_id, service_name, question, instruction).

    ``embed`` must be the function the chunks were ingested with.
    """
    asked = written(retrieval.with_query(questions).withColumn("vector", embed(F.col("query"))), "questions")
    index = store.cells()
    return retrieval.retrieve(asked, store.read(), find=retrieval.nearest if index is None else cells.finder(index))
