"""Quality rules and a log-likelihood ratio of hashed n-grams.

A document is scored by how much likelier its hashed n-grams are under the
multinomial of a trusted set than under that of the whole corpus, per n-gram.
The verdict compares this with one threshold, so it is the same on every run.
All columns are built-in expressions; a document never leaves its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import WHITE_SPACE, words
from cratewise.operators.ordered import grouped_quantiles
from cratewise.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class QualityModel:
    """``weights``: one row with the log ratio of each bucket; ``threshold``: one row with the least score kept."""

    weights: DataFrame
    threshold: DataFrame
    buckets: int
    orders: tuple[int, ...]


def _gram_hashes(hashes: Column, orders: tuple[int, ...]) -> Column:
    parts = [hashes if n == 1 else _runs(hashes, n) for n in orders]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return (docs.withColumn("_words", words(F.col(text)))
            .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))))


def trusted_sample(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """The trusted documents of the labelled ones; with ``limit`` at most so many, in the order of a hash of their ids.

    ``_part`` is 0 for documents that train the multinomial, 1 for those that
    place the threshold. A document with several labels counts by its worst.
    """
    trusted = (labels.where("doc_id is not null").groupBy("doc_id")
               .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
               .where("quality = 1 and toxic = 0")
               .select("doc_id", F.xxhash64("doc_id").alias("_order")))
    if limit is not None:
        trusted = trusted.orderBy("_order").limit(limit)
    return trusted.select("doc_id", F.pmod("_order", F.lit(2)).alias("_part"))


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", buckets: int = 1 << 16,
                orders: tuple[int, ...] = (1,), smoothing: float = 1.0, loss: float = 0.01) -> QualityModel:
    """Count the hashed n-grams of all ``docs`` and of all trusted ones by ``labels``.

    Half of the trusted documents train the multinomial, the others place the
    threshold; their ids are broadcast while they are few. ``loss`` is the share
    of held-out trusted documents that may score below the threshold. Without
    held-out trusted documents nothing falls below it.
    """
    trusted_ids = stored(trusted_sample(labels), "trusted")
    marked = joined_small(docs.select("doc_id", F.col(text).alias("_text")), trusted_ids, ["doc_id"], "left")
    trusted = (F.coalesce("_part", F.lit(1)) == 0).cast("long").alias("_trusted")
    if orders == (1,):  # single words need no array of hashes
        exploded = marked.select(trusted, F.explode_outer(words(F.col("_text"))).alias("_word")).where("_word is not null").select("_trusted", F.xxhash64("_word").alias("_gram"))
    else:
        exploded = _hashed(marked, "_text").select(trusted, F.explode_outer(_gram_hashes(F.col("_hashes"), orders)).alias("_gram")).where("_gram is not null")
    grams = (exploded.groupBy(F.pmod("_gram", F.lit(buckets)).cast("int").alias("_bucket"))
             .agg(F.count(F.lit(1)).alias("_raw"), F.sum("_trusted").alias("_good")))
    table = (docs.sparkSession.range(0, buckets, 1, 8).select(F.col("id").cast("int").alias("_bucket"))
             .join(grams, "_bucket", "left").na.fill(0, ["_raw", "_good"]))
    row = table.agg(F.array_sort(F.collect_list(F.struct("_bucket", "_raw", "_good"))).alias("c"),
                    F.sum("_raw").alias("raw"), F.sum("_good").alias("good"))

    def share(count: Column, total: Column) -> Column:
        return F.log((count + smoothing) / (total + smoothing * buckets))

    weights = cut_lineage(row.select(F.transform("c", lambda x: F.when(F.col("good") == 0, F.lit(0.0)).otherwise(
        share(x["_good"], F.col("good")) - share(x["_raw"], F.col("raw")))).alias("weights")))
    held_out = joined_small(docs.select("doc_id", F.col(text).alias("_text")), trusted_ids.where("_part = 1"), ["doc_id"], "left_semi")
    scored = stored(_with_score(_hashed(held_out, "_text"), weights, buckets, orders).select(F.lit(0).alias("_all"), "llr"), "held-out")
    threshold = cut_lineage(grouped_quantiles(scored, ["_all"], "llr", {"threshold": loss}).agg(
        F.coalesce(F.max("threshold"), F.lit(float("-inf"))).alias("threshold")))
    return QualityModel(weights, threshold, buckets, orders)


def _with_score(hashed: DataFrame, weights: DataFrame, buckets: int, orders: tuple[int, ...]) -> DataFrame:
    """Add ``llr``; the weights are a scalar subquery, sent to each executor once."""
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get("_table", F.pmod(g, F.lit(buckets)).cast("int")))
    return (hashed.withColumn("_grams", _gram_hashes(F.col("_hashes"), orders)).withColumn("_table", weights.scalar())
            .withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams"))).drop("_grams", "_table"))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a["h"] == b["h"], F.lit(False))


def _runs(hashes: Column, span: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - span),
                       lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(span)]))
    return F.when(F.size(hashes) >= span, runs).otherwise(F.array().cast("array<bigint>"))


def quality_signals(docs: DataFrame, *, text: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    span = 3
    df = (_hashed(docs, text)
          .withColumn("_runs", _runs(F.col("_hashes"), span))
          .withColumn("_twice", F.size("_runs") > F.size(F.array_distinct("_runs")))
          .withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != "")))
    # (hash, place) ascending: a run repeats when a neighbour has its hash. The sort is done only where some run repeats.
    pairs = F.sort_array(F.transform("_runs", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(F.col("_twice"), pairs))
    places = F.sort_array(F.transform(
        F.filter("_pairs", lambda x, i: ((i > 0) & _same(F.get("_pairs", i - 1), x)) | _same(F.get("_pairs", i + 1), x)),
        lambda x: x["i"]))
    df = df.withColumn("_places", F.when(F.col("_twice"), places))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last")),
                          lambda s, i: F.struct((s["n"] + F.least(F.lit(span), i - s["last"])).alias("n"), i.alias("last")))["n"]
    df = (df.withColumn("n_words", F.size("_words").cast("long"))
          .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
          .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_runs", "_twice", "_lines", "_pairs", "_places")


def judge_quality(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the signals, ``llr`` (null without n-grams) and ``kept``.

    Null and empty texts have no words, fail the base rule and have null
    ``llr``. Every row is judged alone, so repeated rows get equal verdicts.
    Columns of the result replace columns of ``docs`` that have the same name.
    """
    scored = _with_score(quality_signals(docs, text=text), model.weights, model.buckets, model.orders)
    kept = ~F.col("base_failed") & (F.col("llr") >= model.threshold.scalar())
    return scored.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("_words", "_hashes")


def kept_documents(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only, whatever their names."""
    # The row travels as one column, so that no column of the signals can replace one of the documents.
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row")[text].alias("text"))
    judged = judge_quality(rows, model, text="text")
    # Not a filter on ``kept``: pushed below the projections, it would compute the words again inside every lambda.
    verdict = F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row")
    return judged.select(verdict).where("_row is not null").select("_row.*")
