"""Operators against brute force and small literal inputs."""

import json
import os
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import chunks, names, vectors
from clauseflow.operators import answers, cells, chunking, history, ingest, mentions, readiness, retrieval as R, runs, selection
from clauseflow.plans import catalog, jobs, stream_checks
from clauseflow.plans.retrieval_checks import letter_counts
from clauseflow.session import scratch_dir, written
from clauseflow.sources import crawl, faq, files, html, policies, requests
from clauseflow.sources.store import ChunkStore
from clauseflow.streaming import ingest as stream, runs as run_stream


def test_python_sees_few_rows_and_bytes_at_once(spark):
    sizes = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "long")
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    was = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("10000", str(256 << 20))):
            spark.conf.set(k, v)
        rows = written(spark.range(5000).repartition(1), "rows")
        assert rows.select(sizes("id").alias("n")).agg(F.max("n")).first()[0] <= 1000
        long = rows.limit(100).withColumn("text", F.repeat(F.lit("x"), 1 << 17)).select(F.length("text"), sizes("text").alias("n"))
        assert long.agg(F.max("n")).first()[0] <= 40
        spark.conf.set(keys[0], "7")  # a smaller wish stays
        ChunkStore(spark, scratch_dir(spark, "store"))
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, was):
            spark.conf.set(k, v)


def test_a_round_of_several_files_is_one_batch(spark, monkeypatch):
    lines = spark.createDataFrame([(n % 4, "x" * 99) for n in range(40)], "round long, value string")
    assert stream_checks.files_of_a_round(lines) == 1
    assert stream_checks.files_of_a_round(lines, 300) == 4
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    monkeypatch.setattr(stream_checks, "files_of_a_round", lambda lines: 3)
    name = "streamed_in_small_batches"
    assert oracle.compare(spark, oracle.connect(sf_dir), name, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)[0] is None


def test_times_reach_python_as_whole_numbers(spark, tmp_path):
    verdicts = spark.readStream.schema(run_stream.VERDICTS).json(str(tmp_path))
    assert "unix_micros" in run_stream.ended_runs(verdicts)._jdf.queryExecution().toString().lower()


# ------------------------------------------------------------------- retrieval
def brute_nearest(questions, chunks, pool):
    out = set()
    for qid, scope, vector in questions:
        near = sorted((float(np.sum((np.array(v) - np.array(vector)) ** 2)), cid) for cid, s, v in chunks if s == scope)
        out |= {(qid, cid, n + 1) for n, (_, cid) in enumerate(near[:pool])}
    return out


def test_nearest_both_ways_with_a_hot_scope_and_ties(spark):
    rng = random.Random(6)
    some = [[float(rng.randint(0, 3)) for _ in range(4)] for _ in range(12)]
    # Two thirds of the chunks share one scope, and vectors repeat: many equal distances.
    chunks = [(f"c{n:04d}", "hot" if n % 3 else f"s{n % 5}", rng.choice(some)) for n in range(600)]
    questions = [(n, rng.choice(["hot", "s0", "s1", "nowhere"]), rng.choice(some)) for n in range(80)]
    q = spark.createDataFrame(questions, "question_id long, scope string, vector array<float>").repartition(3)
    c = spark.createDataFrame(chunks, "chunk_id string, scope string, vector array<float>").repartition(5)
    want = brute_nearest(questions, chunks, 7)
    sent = R.nearest(q, c, 7)
    blocks = R.nearest(q, c, 7, broadcast_cells=0, block_questions=9, block_chunks=31)
    for found in (sent, blocks):
        assert {(r.question_id, r.chunk_id, r.rank) for r in found.collect()} == want
    assert "MapInArrow" in sent._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in blocks._jdf.queryExecution().toString()


def test_nearest_on_empty_sides(spark):
    q = spark.createDataFrame([(1, "a", [1.0])], "question_id long, scope string, vector array<float>")
    c = spark.createDataFrame([(1, "a", [1.0])], "chunk_id long, scope string, vector array<float>")
    assert R.nearest(q, c.limit(0), 3).count() == 0
    assert R.nearest(q.limit(0), c, 3).count() == 0
    assert R.nearest(q, c.limit(0), 3, broadcast_cells=0).count() == 0


def _clustered(spark, seed=3):
    """Chunks in clusters, a hot scope, repeated vectors; questions near the clusters."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (24, 8))
    vectors = centres[rng.integers(0, 24, 3000)] + rng.normal(0, 0.3, (3000, 8))
    vectors[::9] = vectors[0]
    chunks = [(f"c{n:05d}", "hot" if n % 3 else f"s{n % 5}", v.tolist()) for n, v in enumerate(vectors)]
    asked = centres[rng.integers(0, 24, 90)] + rng.normal(0, 0.3, (90, 8))
    asked[::7] = vectors[0]
    questions = [(n, ("hot", "s0", "s1", "nowhere")[n % 4], v.tolist()) for n, v in enumerate(asked)]
    questions += [(0, "s2", asked[0].tolist())]  # a question with two scopes
    q = spark.createDataFrame(questions, "question_id long, scope string, vector array<double>").repartition(3)
    c = spark.createDataFrame(chunks, "chunk_id string, scope string, vector array<double>").repartition(5)
    return q, c


def test_cells_find_the_rows_of_all_pairs_with_few_comparisons(spark):
    q, c = _clustered(spark)
    index = cells.fit_cells(c, k=48)
    placed = written(cells.with_cells(c, index), "placed")
    hits, met = cells.search_by_cells(q, placed, 7, index)
    rows = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.distance) for r in df.collect())
    assert rows(hits) == rows(R.nearest(q, c, 7))
    pairs = q.groupBy("scope").count().join(c.groupBy("scope").agg(F.count("*").alias("n")), "scope").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert met.agg(F.sum("n")).first()[0] < 0.25 * pairs
    assert met.groupBy("question_id", "scope", "cell").count().where("count > 1").count() == 0


def test_cells_in_small_blocks_with_old_rows_and_another_scale(spark):
    q, c = _clustered(spark, 5)
    index = cells.fit_cells(c, k=9, sample_rows=400)
    placed = cells.with_cells(c, index)
    old = F.col("chunk_id") < "c00400"
    placed = written(placed.withColumns({x: F.when(~old, F.col(x)) for x in ("cell", "cell_distance")}), "placed")
    rows = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.distance) for r in df.collect())
    assert rows(cells.nearest_by_cells(q, placed, 200, index, block_questions=11, block_chunks=40)) == rows(R.nearest(q, c, 200))
    small = q.withColumn("vector", F.transform("vector", lambda x: x / 1e6))
    assert rows(cells.nearest_by_cells(small, placed, 3, index)) == rows(R.nearest(small, c, 3))


def test_cells_after_a_name_function_was_used(spark):
    # What travels with the search must not hold the name functions, whose handle stays in the driver.
    spark.createDataFrame([("넷플릭스",)], "x string").select(names.folder_name(F.col("x"))).collect()
    q, c = _clustered(spark, 8)
    index = cells.fit_cells(c, k=5)
    assert cells.nearest_by_cells(q, cells.with_cells(c, index), 3, index).count() == R.nearest(q, c, 3).count()


def test_blocks_stay_few_and_vectors_travel_by_part(spark):
    rng = np.random.default_rng(4)
    c = spark.createDataFrame([(n, "s", v.tolist()) for n, v in enumerate(rng.normal(0, 1, (900, 8)))], "chunk_id long, scope string, vector array<double>")
    q = written(c.withColumnRenamed("chunk_id", "question_id"), "q")
    assert R._block_counts(q, c, 2, 3).first()[1:] == (R.FEW_BLOCKS, R.FEW_BLOCKS)
    index = cells.fit_cells(c, k=30)
    placed = written(cells.with_cells(c, index), "placed")
    table = cells._in_parts(cells.cell_table(placed), index, 300)
    # Without clusters nearly all cells are met; a vector goes to three parts, not to thirty cells.
    bounded = q.withColumn("limit", F.lit(1e300))
    assert cells.visits(bounded, table, index, 5, "cells").count() == 900 * 30
    assert cells.visits(bounded, table, index, 5, "parts").count() == 900 * 3
    rows = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.distance) for r in df.collect())
    want = rows(R.nearest(q, c, 5))
    assert rows(R.nearest(q, c, 5, broadcast_cells=0, block_questions=2, block_chunks=3)) == want
    assert rows(cells.nearest_by_cells(q, placed, 5, index, block_questions=70, block_chunks=300)) == want


def test_cells_of_nothing(spark):
    schema = "chunk_id long, scope string, vector array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "s", [1.0, 2.0]), (2, "s", None), (3, None, [1.0, 2.0])], schema)
    asked = spark.createDataFrame([(7, "s", [0.0, 0.0]), (8, "s", None), (9, "t", [0.0, 0.0])], "question_id long, scope string, vector array<double>")
    assert cells.fit_cells(none).centres.size == 0
    empty = cells.with_cells(none, cells.fit_cells(none))
    assert cells.nearest_by_cells(asked, empty, 3, cells.fit_cells(none)).count() == 0
    index = cells.fit_cells(one)
    placed = cells.with_cells(one, index)
    assert [(r.question_id, r.chunk_id, r.distance) for r in cells.nearest_by_cells(asked, placed, 3, index).collect()] == [(7, 1, 5.0)]
    assert cells.nearest_by_cells(asked.limit(0), placed, 3, index).count() == 0
    unplaced = cells.with_cells(one, cells.Cells(np.zeros((0, 0))))
    assert cells.nearest_by_cells(asked, unplaced, 3, cells.Cells(np.zeros((0, 0)))).count() == 1


def test_rerank_by_bits_equals_rerank_by_text(spark):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(70)] + ["환불 조항"]
    chunks = [(n, " ".join(rng.choices(words, k=6)), [float(rng.randint(0, 3)), 0.1 * rng.randint(0, 9)]) for n in range(200)]
    held = spark.createDataFrame(chunks, "chunk_id long, document string, vector array<double>").withColumn("scope", F.lit("s"))
    asked = spark.createDataFrame([(n, " ".join(rng.choices(words, k=rng.randint(0, 9))), "", [1.0, 0.2]) for n in range(30)],
                                  "question_id long, question string, instruction string, vector array<double>")
    asked = R.with_query(asked, words).withColumn("scope", F.lit("s"))
    pool = written(R.nearest(asked, held, 40), "pool")
    by_text = R.rerank(pool, asked, held, 5).select("question_id", "rank", "chunk_id", "keyword_match", "score", "document")
    by_bits = R.rerank(pool, asked, R.with_keyword_bits(held, words), 5).select(*by_text.columns)
    assert sorted(by_bits.collect()) == sorted(by_text.collect()) and by_bits.count() == 150
    # Against the pool without the cut by bounds.
    whole = {}
    texts = {n: t.replace(" ", "") for n, t, _ in chunks}
    kws = {r.question_id: [k.replace(" ", "") for k in r.keywords] for r in asked.collect()}
    for r in pool.collect():
        m = sum(k in texts[r.chunk_id] for k in kws[r.question_id])
        whole.setdefault(r.question_id, []).append((r.distance - m * 0.15, r.distance, r.chunk_id))
    want = sorted((q, k + 1, c) for q, rows in whole.items() for k, (_, _, c) in enumerate(sorted(rows)[:5]))
    assert sorted((r.question_id, r.rank, r.chunk_id) for r in by_bits.collect()) == want
    assert "repartition" not in by_bits._jdf.queryExecution().toString().lower()


def test_many_names_equal_few_literals(spark, monkeypatch):
    rng = random.Random(4)
    known = ["net", "netflix", "티빙", "", "flix tv", "abc"] + [f"name{n}" for n in range(300)]
    rows = [(n, " ".join(rng.choices(known, k=rng.randint(0, 4))), rng.choice([*known, None])) for n in range(150)] + [(999, None, "net")]
    hits = spark.createDataFrame(rows, "n long, document string, asked_service string")
    table = spark.createDataFrame([(k,) for k in known] + [(None,), ("net",)], "name string")
    want = sorted(r.n for r in R.drop_other_services(hits, [k for k in known if k]).collect())
    assert sorted(r.n for r in mentions.drop_rows_naming_others(hits, table).collect()) == want
    monkeypatch.setattr(mentions, "BLOCK_BYTES", 4000)  # many blocks
    assert sorted(r.n for r in mentions.drop_rows_naming_others(hits, table).collect()) == want
    ordered = spark.createDataFrame([(k, 1000 - n, k.upper()) for n, k in enumerate(known)], "name string, place int, value string")
    first = {r.n: r.shown for r in mentions.with_first_name(hits, ordered, "document").collect()}
    for n, text, _ in rows:
        found = [k for k in known if k and k in (text or "")]
        assert first[n] == (found[-1].upper() if found else None)
    assert mentions.drop_rows_naming_others(hits, table.limit(0)).count() == len(rows)


def test_grounding_by_anchors_equals_all_pairs(spark):
    rng = random.Random(12)
    words = "eins zwei drei vier fünf 육 일곱 여덟".split()
    hits = [(n % 4, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for n in range(60)] + [(1, None), (1, "")]
    evidence = []
    for n in range(200):
        run, text = rng.choice(hits[:60])
        a = rng.randrange(len(text) + 1)
        part = text[a : a + rng.randint(0, 80)]
        evidence.append((run if n % 3 else (run + 1) % 5, n, part if n % 4 else part + "x"))
    evidence += [(9, 900, "keine Treffer hier, kein einziger"), (1, 901, None), (1, 902, " ")]
    e = spark.createDataFrame(evidence, "run_id long, sentence_no int, sentence string")
    h = spark.createDataFrame(hits, "run_id long, document string")
    assert sorted(answers.grounding_by_anchors(e, h).collect()) == sorted(answers.grounding(e, h).collect())
    flat = lambda df, c, o: df.select("*", F.regexp_replace(c, r"\\s", "").alias(o))
    pairs, _ = answers.anchored_pairs(flat(e, "sentence", "_sentence"), flat(h.withColumn("hit_no", F.monotonically_increasing_id()), "document", "_text"))
    assert pairs.count() < 0.4 * e.join(h, "run_id").count()
    assert answers.grounding_by_anchors(e.limit(0), h).count() == 0
    assert not any(r.grounded for r in answers.grounding_by_anchors(e, h.limit(0)).collect())


def test_runs_on_a_stream_equal_the_replay(spark, tmp_path):
    from clauseflow.streaming import runs as run_stream

    rng = random.Random(3)
    log = [(n % 30, f"2024-01-01 00:00:{n // 30:02d}", n, rng.choice(["PASS", "FAIL", "FAIL"]), rng.choice(["REGENERATE", "RETRIEVE_AGAIN", "NONE"]))
           for n in range(30 * 6)]
    df = spark.createDataFrame(log, "run_id long, ts string, seq long, status string, action string").withColumn("ts", F.to_timestamp("ts"))
    inbox, target, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for low in (0, 60, 120):  # a stop after each drop; within one, rows are out of order
        df.where((F.col("seq") >= low) & (F.col("seq") < low + 60)).orderBy(F.rand(1)).repartition(2).write.mode("append").json(inbox)
        run_stream.start(spark, inbox, target, at).awaitTermination()
    got = spark.read.schema(run_stream.ENDED).parquet(target)
    want = runs.replay(df.select("run_id").distinct().withColumn("in_scope", F.lit(True)), df).drop("in_scope").where("final_node <> 'unfinished'")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 30


def test_actions_on_nothing_and_on_one_hot_item(spark):
    keys = "item_id long, seq long, action string, qa_id long, todo_id int"
    items = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "item_id long, selected_qa_id long")
    asked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (3, 30, 0)], "item_id long, qa_id long, seq long")
    todos = spark.createDataFrame([(1, 11, 0, True)], "item_id long, qa_id long, todo_id int, checked boolean")
    new = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (9, 90)], "item_id long, qa_id long")
    new_todos = spark.createDataFrame([(1, 12, 0, False)], "item_id long, qa_id long, todo_id int, checked boolean")
    apply = lambda log: [sorted(map(tuple, df.collect()), key=repr) for df in history.apply_actions(
        items, asked, todos, spark.createDataFrame(log, keys), new, new_todos)]
    same = apply([])
    assert same == [[(1, 10), (2, None), (3, 30)], [(1, 10, 0), (1, 11, 1), (3, 30, 0)], [(1, 11, 0, True)]]
    log = [(1, 5, "append", 12, None), (1, 6, "toggle", 12, 0), (1, 7, "toggle", 11, 0), (1, 8, "delete", 12, None), (1, 9, "append", 12, None),
           (1, 10, "toggle", 12, 0), (1, 11, "delete", 12, None), (9, 1, "append", 90, None), (3, 4, "delete_item", None, None), (3, 5, "append", 31, None),
           (2, 3, "append", 20, None), (2, 4, "delete", 99, None)]
    assert apply(log) == [[(1, 10), (2, 20)], [(1, 10, 0), (1, 11, 1), (2, 20, 3)], [(1, 11, 0, False)]]


def _held(spark):
    rows = [
        ("a", "t1", [0.0, 0.1], "환불 조항", "terms", "netflix"), ("b", "t2", [0.0, 0.2], "다른 조항", "terms", "넷플릭스"),
        ("c", "t3", [0.0, 0.0], "쿠팡 약관", "terms", "쿠팡"), ("d", "l1", [0.0, 0.3], "쿠팡의 환불 사례", "law", "none"),
        ("e", "l2", [0.0, 0.5], "일반 법률", "law", "none"), ("f", "f1", [0.0, 0.0], "질문", "faq", "netflix"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, source string, vector array<float>, document string, doc_type string, service_name string").withColumn("article", F.lit("unknown"))


def _asked(spark):
    q = spark.createDataFrame([(1, "netflix", "환불 되나요", "", [0.0, 0.0]), (2, "무명", "안녕", "", [0.0, 0.0])],
                              "question_id long, service_name string, question string, instruction string, vector array<float>")
    return R.with_query(q)


def test_search_expands_aliases_and_adds_bonus(spark):
    hits = {(h.question_id, h.rank): h for h in R.search_terms(_asked(spark), _held(spark)).collect()}
    assert [hits[(1, r)].chunk_id for r in (1, 2)] == ["a", "b"] and (2, 1) not in hits
    assert hits[(1, 1)].keyword_match == 1 and abs(hits[(1, 1)].score - (0.01 - 0.15)) < 1e-6


def test_other_services_are_dropped_by_content(spark):
    kept = {(h.question_id, h.chunk_id) for h in R.reference_context(_asked(spark), _held(spark)).collect()}
    assert kept == {(1, "e"), (2, "e")}
    # FAQ rows are in no preset, but can be asked for.
    faq_hits = R.search_terms(_asked(spark), _held(spark), doc_types=("terms", "faq")).collect()
    assert "f" in {h.chunk_id for h in faq_hits}


def test_render_without_hits(spark):
    both = {r.question_id: r for r in R.retrieve(_asked(spark), _held(spark)).collect()}
    assert both[2].terms_context == V.NO_HITS_TEXT
    assert both[1].terms_context.startswith("[근거 1]\n내용: 환불 조항\n문서 유형: terms\n서비스명: netflix")


# ---------------------------------------------------------------------- ingest
def sequential(batch, stored):
    """Each document in path order against what the store held at the start and what came before."""
    out, fresh = {}, set()
    for source, service, digest in sorted(batch, key=lambda r: r[0]):
        old = [s for s in stored if s[1] == service and s[2] == digest]
        if digest is None:
            out[source] = "empty"
        elif any(s[0] == source and s[2] == digest and s[3] == 5 for s in stored):
            out[source] = "unchanged"
        elif any(s[0] != source for s in old) or (not old and (service, digest) in fresh):
            out[source] = "duplicate"
        else:
            out[source] = "new"
            fresh.add((service, digest))
    return out


def test_judge_equals_sequential(spark):
    rng = random.Random(7)
    for _ in range(6):
        stored = list({(f"s{rng.randint(0, 30):02d}", rng.choice("ab"), f"h{rng.randint(0, 6)}", rng.choice([4, 5])) for _ in range(20)})
        batch = [(f"s{n:02d}", rng.choice("ab"), rng.choice([None] + [f"h{rng.randint(0, 9)}"] * 9)) for n in range(40)]
        got = ingest.judge(
            spark.createDataFrame(batch, "source string, service_name string, document_hash string"),
            spark.createDataFrame(stored, "source string, service_name string, document_hash string, ingest_schema_version int"),
        )
        assert {r.source: r.outcome for r in got.collect()} == sequential(batch, stored)


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "source string, service_name string, text string")
    return df.select(
        "source", F.col("source").alias("source_label"), F.lit("terms").alias("doc_type"), "service_name",
        F.lit("terms_of_use").alias("doc_subtype"), F.lit("file").alias("source_kind"), "text",
    )


LONG = "\n".join(f"제{n}조 " + "조항의 내용을 적는다 " * 12 for n in range(1, 6))


def test_ingest_job_is_idempotent_and_replaces(spark):
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    rows = [("/a", "s", LONG), ("/b", "s", LONG), ("/c", "t", LONG), ("/d", "t", "  "), ("/e", "t", "짧은 글")]
    first = {r.source: (r.outcome, r.n_chunks) for r in jobs.ingest_documents(store, _docs(spark, rows)).collect()}
    assert first == {"/a": ("done", 5), "/b": ("duplicate", 0), "/c": ("done", 5), "/d": ("empty", 0), "/e": ("done", 1)}
    ids = {r.chunk_id for r in store.read().collect()}
    again = {r.source: r.outcome for r in jobs.ingest_documents(store, _docs(spark, rows)).collect()}
    assert again == {"/a": "unchanged", "/b": "duplicate", "/c": "unchanged", "/d": "empty", "/e": "unchanged"}
    assert {r.chunk_id for r in store.read().collect()} == ids and len(ids) == 11
    jobs.ingest_documents(store, _docs(spark, [("/a", "s", "완전히 새로운 글")])).collect()
    assert store.read().where("source = '/a'").count() == 1
    # A changed source whose new text is stored elsewhere keeps its old chunks.
    kept = jobs.ingest_documents(store, _docs(spark, [("/e", "t", LONG)])).first()
    assert kept.outcome == "duplicate" and store.read().where("source = '/e'").count() == 1
    jobs.sweep_files(store, spark.createDataFrame([("/a",), ("/c",)], "path string"))
    assert {r.source for r in store.read().collect()} == {"/a", "/c"}
    packed = store.compact(scratch_dir(spark, "packed"))
    assert packed.read().count() == store.read().count() == 6


def test_user_documents(spark):
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    pasted = spark.createDataFrame([(" s ", LONG, "terms", "terms_of_use")] * 2, "service_name string, text string, doc_type string, doc_subtype string")
    uploads = spark.createDataFrame(
        [("tving", "환불 안내.pdf", LONG + "x", "terms", None), ("tving", "a.txt", LONG + "y", "terms", None), ("tving", "a.txt", LONG + " y", "terms", None)],
        "service_name string, file_name string, text string, doc_type string, doc_subtype string",
    )
    pages = spark.createDataFrame([("s", "https://s.com", LONG, "terms", "privacy_policy"), ("t", "https://t.com", LONG, "law", "unknown")], "service_name string, url string, text string, doc_type string, doc_subtype string")
    first = jobs.ingest_documents(store, jobs.pasted_documents(pasted)).collect()
    assert [r.outcome for r in first] == ["done"] and first[0].source.startswith("pasted::s::")
    jobs.ingest_documents(store, jobs.uploaded_documents(uploads)).collect()
    held = {(r.service_name, r.doc_subtype, r.source_kind) for r in store.documents().collect()}
    assert held == {("s", "terms_of_use", "pasted"), ("티빙", "refund_policy", "upload"), ("티빙", "terms_of_use", "upload")}
    got = {r.source: r.outcome for r in jobs.ingest_documents(store, jobs.url_documents(pages)).collect()}
    assert got == {"https://s.com": "duplicate", "https://t.com": "done"}


def test_uncommitted_version_is_not_read(spark):
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    jobs.ingest_documents(store, _docs(spark, [("/a", "s", LONG)]))
    store.read().write.parquet(store._path("chunks", 2))
    assert store.read().count() == 5
    jobs.ingest_documents(store, _docs(spark, [("/b", "u", "다른 글")]))
    assert store.version() == 2 and store.read().count() == 6


STORED = "source string, chunk_id string, chunk_index int, document string, doc_type string, service_name string, document_hash string"


def _stored(spark, numbers, version=0):
    rows = [(f"s{n}", f"s{n}#{k}", k, f"text {n} {k} {version}", ("terms", "law", None)[n % 3], f"svc{n % 4}", f"h{n}.{version}")
            for n in numbers for k in range(2)]
    return spark.createDataFrame(rows, STORED)


def test_removals_meet_chunks_without_a_shuffle_of_text(spark, monkeypatch):
    from clauseflow.sources import store as module

    held = ChunkStore(spark, scratch_dir(spark, "store"), buckets=4)
    held.commit(_stored(spark, range(60)), _stored(spark, []))
    held.commit(_stored(spark, range(0, 30), 1), _stored(spark, range(0, 40)))
    monkeypatch.setattr(module, "SENT_REMOVALS", 0)
    monkeypatch.setattr(module, "ONE_TASK_REMOVALS", 0)
    held.commit(_stored(spark, []), _stored(spark, [1, 2, 3]))
    rows = R.by_type(held.read(), ("terms",)).select("chunk_id", "document")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan and "PartitionFilters: [" in plan
    assert "doc_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = {f"text {n} {k} {int(n < 30)}" for n in range(60) for k in range(2) if n % 3 == 0 and not 30 <= n < 40 and n not in (1, 2, 3)}
    assert {r.document for r in rows.collect()} == want
    assert held.read().where("doc_type is null").count() == 2 * sum(n % 3 == 2 and not 30 <= n < 40 and n != 2 for n in range(60))


def test_documents_are_found_by_key_in_few_parts(spark, monkeypatch):
    from clauseflow.sources import store as module

    monkeypatch.setattr(module, "SMALL_VERSION", 0)
    monkeypatch.setattr(module, "PART_DOCUMENTS", 10)
    held = ChunkStore(spark, scratch_dir(spark, "store"), buckets=16)
    held.commit(_stored(spark, range(200)), _stored(spark, []))
    held.commit(_stored(spark, range(200, 230)), _stored(spark, [5]))
    keys = spark.createDataFrame([("h7.0",), ("h5.0",), ("h210.0",), ("h7.9",), (None,)], "document_hash string")
    assert {r.source for r in held.documents_with("hash", keys).collect()} == {"s7", "s210"}
    assert {r.source for r in held.documents_with("source", spark.createDataFrame([("s5",), ("s6",), ("x",)], "source string")).collect()} == {"s6"}
    parts = held._parts("hash", keys.select(F.col("document_hash").alias("key")).where("key is not null"), held._live())
    assert 3 <= len(parts) <= 8 and sum(m.parts for m in held._live()) == 20
    assert held.documents_with("hash", keys.limit(0)).count() == 0
    # A batch judged by these rows is judged as by all.
    batch = spark.createDataFrame([("s7", "svc3", "h7.0"), ("new", "svc3", "h7.0"), ("s8", "svc0", "h8.1"), ("e", "svc0", None)], "source string, service_name string, document_hash string")
    some, every = (ingest.stored_documents(d) for d in (held.documents_with("hash", batch), held.documents()))
    assert sorted(map(str, ingest.judge(batch, some).collect())) == sorted(map(str, ingest.judge(batch, every).collect()))


def test_status_follows_the_commits(spark):
    held = ChunkStore(spark, scratch_dir(spark, "store"), buckets=2)
    assert held.status().count() == 0
    held.commit(_stored(spark, range(12)), _stored(spark, []))
    held.commit(_stored(spark, range(6), 1), _stored(spark, range(8)))
    held.commit(_stored(spark, []), _stored(spark, [0, 99]))
    held.commit(_stored(spark, []), _stored(spark, [0]))  # already gone: counted once
    keys = ["service_name", "doc_type", "doc_subtype"]
    want = held.documents().groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks"))
    assert sorted(map(tuple, held.status().collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert held.status().agg(F.sum("chunks")).first()[0] == held.read().count() == 18
    services = spark.createDataFrame([("svc0",), ("svc1",)], "service_name string")
    assert sorted(readiness.readiness(services, held.status()).collect()) == sorted(readiness.readiness(services, held.documents()).collect())


def test_folding_keeps_the_rows_and_bounds_the_folders(spark, tmp_path):
    held = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    live = {}
    for n in range(14):
        added, gone = [n, n + 1], [n - 1] if n % 3 == 0 else []
        held.commit(_stored(spark, added, n), _stored(spark, added + gone), f"stream:{n}")
        live |= {s: n for s in added}
        for s in gone:
            live.pop(s, None)
        held.fold(3)
        if n in (5, 13):
            assert {r.document for r in held.read().collect()} == {f"text {s} {k} {v}" for s, v in live.items() for k in range(2)}
            assert held.status().agg(F.sum("documents")).first()[0] == held.documents().count() == len(live)
    assert len(held._live()) <= 3
    for kind in ("chunks", "documents", "status", "commits"):
        assert len([d for d in os.listdir(tmp_path / "store" / kind) if d.startswith("v=")]) <= 9
    assert held.has_transaction("stream:13") and held.has_transaction("stream:2") and not held.has_transaction("stream:14")
    assert not held.has_transaction("other:1") and held.fold(3) is None
    packed = held.compact(str(tmp_path / "packed"), buckets=3)
    assert packed.buckets() == 3 and packed.read().count() == 2 * len(live)


def test_cells_of_a_store(spark):
    held = ChunkStore(spark, scratch_dir(spark, "store"), buckets=2)
    embed = vectors.embedder(letter_counts)
    assert held.cells() is None
    jobs.ingest_documents(held, _docs(spark, [(f"/{n}", "s", f"{LONG} {chr(97 + n) * 40}") for n in range(6)]), embed=embed)
    jobs.index_vectors(held, 3)
    jobs.ingest_documents(held, _docs(spark, [("/z", "s", LONG.replace("조항", "zz"))]), embed=embed)
    assert held.read().where("cell is not null").count() == 5 and held.read().where("keyword_bits is null").count() == 0
    asked = spark.createDataFrame([(1, "s", "zz?", "")], "question_id long, service_name string, question string, instruction string")
    with_cells = jobs.answer_contexts(held, asked, embed).first()
    fresh = jobs.compact(held, scratch_dir(spark, "fresh"), 4)
    assert fresh.read().where("cell is null").count() == 0
    plain = R.retrieve(R.with_query(asked).withColumn("vector", embed(F.col("query"))), held.read()).first()
    assert with_cells == plain == jobs.answer_contexts(fresh, asked, embed).first()


def test_one_order_over_kinds_of_files_and_paged_files(spark, tmp_path):
    for name, text in {
        "terms/s/b.txt": LONG, "terms/s/c.txt": LONG + " 더",
        "a/kb.jsonl": json.dumps({"service_name": "s", "source_url": "https://s.com/p", "text": LONG}) + "\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    for name in ("x.pdf", "y.pdf", "z.pdf"):
        (tmp_path / "terms" / "s" / name).write_bytes(b"%PDF")
    at = f"file://{tmp_path}/terms/s/"
    pages = spark.createDataFrame([(at + "x.pdf", 1, LONG + " 쪽"), (at + "x.pdf", 2, " "), (at + "y.pdf", 1, "")], "path string, page_no int, text string")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    counts = jobs.ingest_folder(store, str(tmp_path), pages=pages).first()
    # The crawl line is first in path order, so the equal text file is the copy; y and z have no text.
    held = {r.source.split("/")[-1] for r in store.documents().collect()}
    assert held == {"p", "c.txt", "x.pdf"}
    assert (counts.succeeded, counts.failed, counts.sources, counts.chunks) == (4, 2, 6, store.read().count())


def test_upload_batch_is_checked(spark):
    rows = [("tving", "terms", "a.txt", 9, LONG), ("tving", "law", "a.txt", 9, LONG), ("tving", "privacy", "b.exe", 9, LONG), (" ", "terms", "a.txt", 9, LONG)]
    docs, rejected = jobs.upload_batch(spark.createDataFrame(rows, "service_name string, document_type string, file_name string, n_bytes long, text string"))
    assert [(r.service_name, r.doc_subtype, r.source_kind) for r in docs.collect()] == [("티빙", "terms_of_use", "upload")]
    assert sorted(r.reject_reason for r in rejected.collect()) == ["document_type", "service_blank", "suffix"]


def test_cascade_strategies(spark):
    rows = [
        (1, "law", "제1조 a\n제2조 b\n제3조 c"), (2, "law", "1. a\n2. b\n3. c"), (3, "guideline", "1. a\n2. b\n3. c"),
        (4, "terms", "머리말입니다.\n첫 제목\n내용입니다.\n둘째 제목\n내용입니다."), (5, "law", "제1조 a 제2조 b"[:6]), (6, "misc", "제1조 a\n제2조 b\n제3조 c"),
    ]
    got = chunking.with_parts(spark.createDataFrame(rows, "id int, doc_type string, text string")).collect()
    assert {r.id: r.strategy for r in got} == {1: "article", 2: "outline", 3: "numbered", 4: "heading", 5: "window", 6: "window"}


def test_folder_job(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in {
        "terms/tving/terms.txt": LONG, "law/a.txt": LONG.replace("조항", "법률"),
        "faq/kca.json": json.dumps([{"question": "환불?", "answer": "네"}, {"question": " ", "answer": "x"}]),
        "faq/bad.json": json.dumps([{"question": "q"}]),
        "crawl/kb.jsonl": json.dumps({"service_name": "s", "document_type": "privacy", "source_url": "https://s.com/p", "text": "개인정보 " * 60}) + "\n{broken\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    embed = vectors.embedder(letter_counts)
    counts = jobs.ingest_folder(store, str(root), embed=embed).first()
    assert (counts.succeeded, counts.failed, counts.sources) == (4, 1, 5)
    held = store.read()
    assert {(r.doc_type, r.service_name) for r in held.collect()} == {("terms", "tving"), ("law", "none"), ("faq", "none"), ("terms", "s")}
    assert held.where("doc_type = 'faq'").first().chunk_index == 0
    status = jobs.services_status(store, spark.createDataFrame([("TVING",), ("s",)], "service_name string"))
    assert {r.service_name: (r.has_terms, r.has_privacy, r.reference_ready) for r in status.collect()} == {
        "티빙": (True, False, False), "s": (False, True, False),
    }
    asked = spark.createDataFrame([(1, "티빙", "조항?", "")], "question_id long, service_name string, question string, instruction string")
    contexts = jobs.answer_contexts(store, asked, embed).first()
    assert "제1조" in contexts.terms_context and "법률" in contexts.reference_context
    assert files.list_files(spark, str(root / "missing")).count() == 0


def test_stream_skips_a_replayed_batch(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    line = json.dumps({"service_name": "s", "source_url": "https://s.com/p", "text": LONG}, ensure_ascii=False)
    (inbox / "a.jsonl").write_text(line + "\n", encoding="utf-8")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    stream.start(store, str(inbox), str(tmp_path / "one")).awaitTermination()
    assert store.read().count() == 5 and store.version() == 1
    # The job died before the stream noted the batch: it comes again under its number.
    for mark in ("0", ".0.crc"):
        (tmp_path / "one" / "commits" / mark).unlink()
    stream.start(store, str(inbox), str(tmp_path / "one")).awaitTermination()
    assert store.version() == 1
    # Another stream has numbers of its own, under whatever name.
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.jsonl").write_text(line.replace("s.com/p", "s.com/q").replace("조항", "규정") + "\n", encoding="utf-8")
    stream.start(store, str(tmp_path / "other"), str(tmp_path / "two")).awaitTermination()
    assert {r.source for r in store.read().select("source").distinct().collect()} == {"https://s.com/p", "https://s.com/q"}


def test_a_stream_hands_few_rows_to_python_at_once(spark, tmp_path, monkeypatch):
    """Also if larger batches were set after the store was made."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    was, held = [spark.conf.get(k) for k in keys], []
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.jsonl").write_text("{}\n", encoding="utf-8")
    monkeypatch.setattr(stream.jobs, "ingest_crawl", lambda store, lines, *rest: held.append([int(lines.sparkSession.conf.get(k)) for k in keys]))
    try:
        store = ChunkStore(spark, scratch_dir(spark, "store"))
        for k, v in zip(keys, ("10000", str(256 << 20))):
            spark.conf.set(k, v)
        stream.start(store, str(tmp_path / "inbox"), str(tmp_path / "one")).awaitTermination()
    finally:
        for k, v in zip(keys, was):
            spark.conf.set(k, v)
    assert held == [[1000, 4 << 20]]


def test_a_second_writer_fails_until_the_store_is_unlocked(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "source string")
    assert store.commit(none, none) == 1
    (tmp_path / "store" / "lock").touch()
    with pytest.raises(RuntimeError):
        store.commit(none, none)
    store.unlock()
    assert store.commit(none, none) == 2


def test_rows_without_vectors_are_not_searched(spark):
    schema = "chunk_id long, scope string, vector array<double>"
    held = spark.createDataFrame([(1, "s", [1.0, 1.0, 1.0, 1.0]), (2, "s", None), (3, None, [0.0] * 4)], schema)
    asked = spark.createDataFrame([(7, "s", [0.0] * 4), (8, "s", None)], "question_id long, scope string, vector array<double>")
    for cells in (0, 10**6):
        got = R.nearest(asked, held, 5, broadcast_cells=cells).collect()
        assert [(r.question_id, r.chunk_id, r.distance) for r in got] == [(7, 1, 4.0)]


def test_both_plans_give_the_same_rows_on_doubles(spark):
    held = spark.createDataFrame([(1, "s", [0.1, 0.2]), (2, "s", [0.10000000149, 0.2])], "chunk_id long, scope string, vector array<double>")
    asked = spark.createDataFrame([(7, "s", [0.1, 0.2])], "question_id long, scope string, vector array<double>")
    for cells in (0, 10**6):
        assert [(r.chunk_id, r.rank) for r in R.nearest(asked, held, 2, broadcast_cells=cells).orderBy("rank").collect()] == [(1, 1), (2, 2)]
        assert R.nearest(asked, held, 2, broadcast_cells=cells).where("rank = 1").first().distance == 0.0


def test_scores_are_written_in_plain_form(spark):
    df = spark.createDataFrame([(0.0005,), (1234567890.5,), (0.0,), (-2.0,), (0.75,)], "x double")
    assert [r[0] for r in df.select(R.plain_number(F.col("x"))).collect()] == ["0.0005", "1234567890.5", "0.0", "-2.0", "0.75"]


def test_other_spellings_find_the_service(spark):
    held = spark.createDataFrame([(k, n) for k, n in enumerate(("netflix", "넷플릭스", "other"))], "k long, service_name string")
    for asked in ("Netflix", " netflix", "넷플릭스"):
        question = spark.createDataFrame([(1, asked)], "question_id long, service_name string")
        scopes = {r.scope for r in R.service_scopes(question).collect()}
        assert {"netflix", "넷플릭스"} <= scopes
        assert {r.k for r in R.by_service(held, asked).collect()} == {0, 1}


def test_missing_request_fields_are_rejected(spark):
    rows = [("s", None, "a.pdf", 1), ("s", "terms", None, 1), ("s", "terms", "a.pdf", None), ("s", "terms", "a.pdf", 1)]
    checked = requests.check_uploads(spark.createDataFrame(rows, "service_name string, document_type string, file_name string, n_bytes long"))
    assert [r.reject_reason for r in checked.collect()] == ["document_type", "suffix", "empty_file", None]
    urls = requests.explicit_urls(spark.createDataFrame([("s", None, "https://a")], "service_name string, kind string, url string"))
    assert urls.first().reject_reason == "kind"


def test_equal_crawl_lines_are_taken_in_their_order(spark, tmp_path):
    def line(url):
        return json.dumps({"service_name": "s", "source_url": url, "text": LONG}, ensure_ascii=False) + "\n"

    (tmp_path / "a.jsonl").write_text(line("https://z.com/1") + line("https://a.com/1"), encoding="utf-8")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    jobs.ingest_crawl(store, crawl.read_lines(spark, str(tmp_path)))
    assert {r.source for r in store.read().collect()} == {"https://z.com/1"}


def test_a_badly_encoded_faq_file_is_one_rejected_file(spark, tmp_path):
    (tmp_path / "faq").mkdir()
    (tmp_path / "faq" / "bad.json").write_bytes('[{"question": "환불"}]'.encode("cp949"))
    (tmp_path / "faq" / "good.json").write_text('[{"question": "q", "answer": "a"}]', encoding="utf-8")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    counts = jobs.ingest_folder(store, str(tmp_path)).first()
    assert (counts.succeeded, counts.failed) == (1, 1)


@pytest.mark.parametrize("make", [
    lambda: ("merge", ["ab"] * 40_000), lambda: ("windows", "x" * 2_000_000), lambda: ("guide", "\n" * 32_000 + "1. a"),
])
def test_chunking_is_linear(spark, make):
    import time

    kind, data = make()
    df = spark.createDataFrame([(data,)], "d array<string>" if kind == "merge" else "d string")
    parts = {
        "merge": lambda: chunks.merge_short(F.col("d"), 10**9), "windows": lambda: chunks.fixed_windows(F.col("d")),
        "guide": lambda: chunks.split_before(F.col("d"), chunks.BEFORE_GUIDELINE),
    }[kind]()
    start = time.time()
    df.select(F.size(parts)).collect()
    assert time.time() - start < 10


# --------------------------------------------------------------------- sources
def test_faq_files(spark):
    rows = [("/a", '[{"question":"q","answer":"a","keywords":["x","y"]},{"question":"","answer":"b"}]'), ("/b", '{"question":"q","answer":"a"}'),
            ("/c", '[{"question":"q"}]'), ("/d", "[1]"), ("/e", "no json"), ("/f", "[]")]
    parsed = faq.parse_files(spark.createDataFrame(rows, "path string, text string"))
    assert {r.path: None if r["items"] is None else len(r["items"]) for r in parsed.collect()} == {
        "/a": 2, "/b": None, "/c": None, "/d": None, "/e": None, "/f": 0,
    }


def test_policy_write_replaces_only_its_partitions(spark, tmp_path):
    def pages(*rows):
        return spark.createDataFrame(rows, "service_name string, kind string, final_url string, text string")

    root = str(tmp_path / "p")
    policies.write_policies(pages(("a", "terms", "u1", "old"), ("b", "terms", "u2", "b")), root)
    policies.write_policies(pages(("a", "terms", "u3", "new")), root)
    got = {(r.service, r.kind): r.content for r in spark.read.parquet(root).collect()}
    assert got == {("a", "terms"): "참조 URL: u3\n\nnew", ("b", "terms"): "참조 URL: u2\n\nb"}


def test_main_text_order(spark):
    body = "단어 " * 150
    rows = [
        (1, f"<body><article>{body}</article><div id=printDiv>print {body}</div></body>"),
        (2, f"<body><main><article>x</article><p>{body}</p></main></body>"),
        (3, f"<body><div class='a terms-content'>short</div><p>{body}</p><script>no</script></body>"),
        (4, "<body>short</body>"),
        (5, f"<body><article>nav</article><main><article>in main {body}</article></main></body>"),
    ]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, h string").select("i", html.main_text(F.col("h")).alias("t")).collect()}
    assert got[1].startswith("print") and got[2].startswith("x\n") and got[3].startswith("short\n")
    assert "no" not in got[3] and got[4] == "" and got[5].startswith("in main")


# ------------------------------------------------------------------- selection
def _pick(spark, rows):
    df = spark.createDataFrame(rows, "service_name string, query_no int, rank int, url string, title string, content string")
    return [(r.domain, r.score) for r in selection.pick_domains(selection.score_domains(df)).collect()]


def test_official_domain_needs_the_name_in_the_host(spark):
    assert _pick(spark, [("acme", 0, 0, "https://other.com/", "official", "")]) == []
    assert _pick(spark, [("acme", 0, 7, "https://acme.com/x", "", ""), ("acme", 1, 7, "https://acme.org/x", "", "")]) == [("acme.com", 93)]
    assert _pick(spark, [("acme", 0, 0, "https://www.acme.com", "공식", "")]) == [("www.acme.com", 135)]


def test_failed_explicit_url_skips_known_but_not_search(spark):
    text = "이용약관 " * 100
    pages = spark.createDataFrame([("https://a.com/e", "https://a.com/e", "", " "), ("https://a.com/k", "https://a.com/k", "", text), ("https://a.com/s", "https://a.com/s", "", text)], "url string, final_url string, title string, text string")
    rows = [("a", "terms", "a.com", 0, 0, "https://a.com/e"), ("a", "terms", "a.com", 1, 0, "https://a.com/k"), ("a", "terms", "a.com", 2, 0, "https://a.com/s")]
    schema = "service_name string, kind string, domain string, priority int, rank int, url string"
    assert selection.choose_pages(spark.createDataFrame(rows, schema), pages).first().url == "https://a.com/s"
    assert selection.choose_pages(spark.createDataFrame(rows[1:], schema), pages).first().url == "https://a.com/k"


# ------------------------------------------------------------------------ runs
def test_replay_scenarios(spark):
    rows = [
        ("refund", 1, "PASS", "NONE"), ("renewal", 1, "FAIL", "REGENERATE"), ("renewal", 2, "PASS", "NONE"),
        ("privacy", 1, "FAIL", "RETRIEVE_AGAIN"), ("privacy", 2, "PASS", "NONE"),
        ("hopeless", 1, "FAIL", "NONE"), ("hopeless", 2, "FAIL", "REGENERATE"), ("hopeless", 3, "FAIL", "REGENERATE"), ("hopeless", 4, "PASS", "NONE"),
        ("cut", 1, "FAIL", "NONE"),
    ]
    log = spark.createDataFrame([(r, n, n, s, a) for r, n, s, a in rows], "run_id string, ts int, seq int, status string, action string")
    table = spark.createDataFrame([(r, True) for r in ("refund", "renewal", "privacy", "hopeless", "cut")] + [("off", False)], "run_id string, in_scope boolean")
    got = {r.run_id: (r.retrievals, r.verifications, r.final_node) for r in runs.replay(table, log).collect()}
    final, poor = "generate_final_answer", "generate_insufficient_evidence_answer"
    assert got == {
        "refund": (1, 1, final), "renewal": (1, 2, final), "privacy": (2, 2, final), "hopeless": (2, 3, poor),
        "cut": (2, 1, "unfinished"), "off": (0, 0, "generate_out_of_scope_answer"),
    }


def test_routes(spark):
    df = spark.createDataFrame([("FAIL", 1, "NONE"), ("FAIL", 2, "REGENERATE"), ("PASS", 2, None)], "s string, n int, a string")
    got = df.select(runs.route_verdict(F.col("s"), F.col("n")), runs.route_improvement(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [
        ("improve_strategy", "retrieve_context"), ("generate_insufficient_evidence_answer", "generate_answer"), ("generate_final_answer", "retrieve_context"),
    ]


def test_answers_with_broken_fields(spark):
    rows = [(1, '{"problem_type":"환불","terms_evidence":"x","next_actions":[1,"b"]}'), (2, '{"message":"밖"}'), (3, "no json")]
    got = {r.id: r for r in answers.parse_answers(spark.createDataFrame(rows, "id int, answer string")).collect()}
    assert got[1].terms_evidence == [] and got[1].next_actions == ["1", "b"] and got[1].category == "refund"
    assert got[2].simple_explanation == "밖" and got[2].problem_type == V.DEFAULT_PROBLEM_TYPE
    assert got[3].simple_explanation == V.DEFAULT_EXPLANATION


def test_history_flatten(spark):
    nested = spark.createDataFrame(
        [(1, "s", "q2", [("q1", "one", [("t", "do", False)]), ("q2", "two", [])])],
        "item_id int, service_name string, selected_qa_id string, queries array<struct<qa_id:string,question:string,todo:array<struct<todo_id:string,text:string,checked:boolean>>>>",
    )
    items, asked, todos = history.flatten(nested)
    assert [(r.qa_id, r.seq) for r in asked.orderBy("seq").collect()] == [("q1", 0), ("q2", 1)]
    assert tuple(todos.first()) == (1, "q1", "t", "do", False)
    toggled = history.toggle_todos(todos, spark.createDataFrame([(1, "q1", "t")] * 3, "item_id int, qa_id string, todo_id string"))
    assert toggled.first().checked is True
    moved, left = history.delete_questions(items, asked, spark.createDataFrame([(1, "q2")], "item_id int, qa_id string"))
    assert moved.first().selected_qa_id == "q1" and left.count() == 1
    none, _ = history.delete_questions(items, asked, spark.createDataFrame([(1, "q1"), (1, "q2")], "item_id int, qa_id string"))
    assert none.first().selected_qa_id is None


def test_readiness_counts_both_spellings(spark):
    held = spark.createDataFrame([("terms", "tving", "terms_of_use"), ("terms", "티빙", "privacy_policy"), ("law", "none", "unknown")], "doc_type string, service_name string, doc_subtype string")
    row = readiness.readiness(spark.createDataFrame([("Tving",)], "service_name string"), held).first()
    assert row.service_name == "티빙" and row.service_ready and row.missing == [] and not row.reference_ready


def test_last_line_per_source_follows_file_order(spark, tmp_path):
    def line(text):
        return json.dumps({"service_name": "s", "source_url": "https://s.com", "text": text * 100}) + "\n"

    (tmp_path / "a.jsonl").write_text(line("one ") + line("two "))
    (tmp_path / "b.jsonl").write_text(line("three "))
    docs = crawl.last_per_source(crawl.parse_lines(crawl.read_lines(spark, str(tmp_path))))
    assert [r.text[:5] for r in docs.collect()] == ["three"]


def test_task_functions_need_no_installed_package(spark, tmp_path):
    """Executors get the functions with the query, from whatever folder they run in."""
    assert "clauseflow" not in os.environ.get("PYTHONPATH", "")
    df = spark.createDataFrame([("x " * 900,)], "text string").withColumn("doc_type", F.lit("misc"))
    assert len(chunking.with_parts(df).first().parts) == 2


def test_no_text_is_cleaned_twice_for_its_hash(spark):
    """What the queries leave to their last job reads written hashes, and written cleaned texts."""
    registered = catalog.QUERIES
    for name in ("unchanged_sources", "ingested_chunks"):
        plan = registered[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "{2,10}" not in plan, name  # the pattern of doubled labels


def test_hashes_of_prepared_equal_hashes(spark):
    texts = [None, "", " \n ", "a  b", "haha x", "\u3000", "\x1c", "tick tick\n\n\ntock"]
    docs = spark.createDataFrame([(str(i), "s", t) for i, t in enumerate(texts)], "source string, service_name string, text string")
    assert sorted(ingest.hashes_of_prepared(ingest.prepare(docs)).collect()) == sorted(ingest.hashes(docs).collect())
