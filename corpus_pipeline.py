"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept. Between stages the documents
are written as Parquet in the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.llm import containment, minhash_tensor, packing, pseudonyms, quality
from cratewise.llm.queries import QUERY_KEY, vocabulary
from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import prepare
from cratewise.plans.registry import Book

BOOK = Book()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the likelihood ratio reject."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, quality.fit_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; of rows that repeat an id one stays."""
    prepare(spark)
    classes = stored(minhash_tensor.near_duplicates(docs).select("doc_id", "kept"), "classes")
    kept = joined_small(docs, classes.where("not kept").select("doc_id").distinct(), ["doc_id"], "left_anti")
    again = stored(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return joined_small(kept, again, ["doc_id"], "left_anti").unionByName(
        joined_small(kept, again, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return containment.without_contaminated(docs, stored(containment.contained_items(docs, items), "found"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by pseudonyms; n_chars follows the text."""
    prepare(spark)
    fresh = pseudonyms.pseudonymize(docs, QUERY_KEY, count="_n_private", spans="_private_spans").select(*docs.columns)
    return fresh.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else fresh


def exact_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_exact(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("personal data", personal_data), ("best-fit packing", exact_packing)]

# The stages hash, sketch and tokenize, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


@BOOK.query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
