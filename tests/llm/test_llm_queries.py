"""The registered training-data queries and the pipeline on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from clauseflow.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    problem, _ = oracle.compare(spark, oracle.connect(SF_DIR), name, lambda s, d: df, queries.ORACLES.get(name), SF_DIR)
    assert problem is None
    per_document = {1, 5, 6, 7, 9, 10, 11, 13}
    if int(re.match(r"op(\d+)", name)[1]) in per_document:
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
        assert df.count() == docs.count() and df.select("doc_id").exceptAll(docs).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.saved(stage(spark, kept[-1], SF_DIR), name)[0])
    for before, after in zip(kept[:4], kept[1:4]):
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0
    toxic = queries.QUERIES["op6_toxicity"](spark, SF_DIR).where("predicted = 1").select("doc_id")
    assert kept[1].join(toxic, "doc_id").count() == 0 and kept[1].count() + toxic.count() == docs.count()
    groups = corpus_pipeline.ngram_join.ngram_components(kept[1]).select("component_id").distinct().count()
    assert kept[2].count() == groups
    assert corpus_pipeline.decontaminate.without_leaks(kept[3], spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).count() == kept[3].count()
    assert kept[4].columns == docs.columns
    assert kept[5].columns == [*docs.columns, "shard"] and kept[5].count() == kept[4].count()
    size = F.sum(F.octet_length("text") + 1).alias("size")
    sizes = [r["size"] for r in kept[5].groupBy("shard").agg(size).collect()]
    largest = kept[5].groupBy("text").agg(size).agg(F.max("size")).first()[0]
    assert len(sizes) == 16 and max(sizes) <= max(largest, 1.2 * sum(sizes) / 16)


def test_pipeline_takes_rows_without_ids_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50)).withColumn("_key", F.lit("k")).withColumn("shard", F.lit(9))
    odd = odd.unionByName(odd.limit(5)).unionByName(odd.limit(2).withColumn("text", F.lit(None).cast("string")))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows, at in ((odd, "odd"), (odd.limit(0), "none")):
        rows.write.parquet(str(tmp_path / at / "documents.parquet"))
        for name in ("labels", "benchmark"):
            (tmp_path / at / f"{name}.parquet").symlink_to(tmp_path / f"{name}.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path / at))
        assert out.columns == [*odd.columns, "shard_"] and (out.count() > 0) == (at == "odd")
        assert out.drop("shard_").exceptAll(odd.unionByName(odd)).count() == 0
        texts = out.groupBy("text").agg(F.countDistinct("shard_").alias("n")).where("n > 1")
        assert texts.count() == 0
