"""The pipeline against plain definitions of its stages, on the smallest tables."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cratewise.llm import pseudonyms, quality
from cratewise.llm.storage import stored
from tests.llm.common import clashing, components, shingles, words

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            seen[name] = {r["doc_id"]: r for r in docs.collect()}
            assert docs.count() == len(seen[name])
    quality, near, clean, private, packing = (name for name, _ in corpus_pipeline.STAGES)

    assert 0 < len(seen[quality]) < len(before[quality])
    for i, row in before[quality].items():
        if len(words(row["text"])) < 50:
            assert i not in seen[quality]
    classes = components({i: shingles(r["text"]) for i, r in before[near].items()})
    assert set(seen[near]) == set(classes.values())
    items = [shingles(t) for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()]
    tainted = {i for i, r in before[clean].items() for s in items if 100 * len(s & shingles(r["text"])) >= 80 * len(s)}
    assert set(seen[clean]) == set(before[clean]) - tainted
    for i, row in before[private].items():
        fresh = pseudonyms.replace_values(row["text"], corpus_pipeline.QUERY_KEY)[0]
        assert seen[private][i]["text"] == fresh and seen[private][i]["n_chars"] == len(fresh)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.collect()
    total = sum(r["length"] for r in rows)
    assert total == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before[packing].values())
    filled = np.bincount([r["sequence_id"] for r in rows], weights=[r["length"] for r in rows])
    assert filled.max() <= 2048 and len(filled) <= -(-total // 2048) + 2


def test_extra_columns_null_ids_and_repeated_rows_survive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality.judge_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    kept = [r["doc_id"] for r in sorted(judged, key=lambda r: (-(r["llr"] or 0), r["doc_id"])) if r["kept"] and r["n_words"] > 200]
    rejected = min(r["doc_id"] for r in judged if r["base_failed"])
    null = F.lit(None).cast("bigint")
    # Two rows without id: a rejected text, and a kept one in another order of words, a copy of none.
    bad = docs.where(F.col("doc_id") == rejected).withColumn("doc_id", null)
    good = docs.where(F.col("doc_id") == kept[0]).withColumn("doc_id", null).withColumn(
        "text", F.array_join(F.reverse(F.split("text", " ")), " "))
    repeated = docs.where(F.col("doc_id").isin(kept[:3]))
    docs = clashing(docs.unionByName(repeated).unionByName(bad).unionByName(good))
    columns, without = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        assert docs.where("llr <> 'taken' or kept <> 'taken'").count() == 0
        without.append(docs.where("doc_id is null").count())
    assert without == [1, 1, 1, 1]  # the rejected one goes in the first stage
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.exact_packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids)


def test_empty_table_and_registration(spark):
    import __spark_entry__

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.count() == 0
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
