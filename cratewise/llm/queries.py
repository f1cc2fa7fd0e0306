"""The queries of this package: name, plan, and SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.llm import (containment, factor_quality, html_blocks, lm_scoring, minhash_tensor, packing, pseudonyms, quality, repeats, secret_scan,
                           squares, whitening)
from cratewise.llm.text import prepare, words
from cratewise.plans.registry import Book

BOOK = Book()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@BOOK.query("op8_quality_llr")
def op8_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@BOOK.query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, secret_scan.fit_markov(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_markov",
                        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


def vocabulary() -> str:
    """The vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@BOOK.query("op3_packed_ids")
def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrix(table(spark, sf_dir, "documents"), vocabulary())


@BOOK.query("op6_exact_packing")
def op6_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_exact(table(spark, sf_dir, "documents"), vocabulary())


@BOOK.query("op4_minhash_tensor")
def op4_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_tensor.near_duplicates(table(spark, sf_dir, "documents"))


# The rows are the pairs; a shingle is five lower-cased words.
OP9_SQL = """
with w as (
  select 'd' as side, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
l as (select side, id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from w),
s as (select distinct side, id, array_to_string(w[k:k + 4], ' ') as s
      from (select side, id, w, unnest(range(1, len(w) - 3)) as k from l where len(w) >= 5)),
n as (select id, count(*) as n_item from s where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, n.n_item, count(*) as n_shared
from s d join s i on d.s = i.s and d.side = 'd' and i.side = 'i' join n on n.id = i.id
group by d.id, i.id, n.n_item having 100 * count(*) >= 80 * n.n_item
"""


@BOOK.query("op9_containment", OP9_SQL)
def op9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# A key of the queries over test tables; a caller of the operator brings a secret one.
QUERY_KEY = b"key of the registered query"


@BOOK.query("op10_pseudonyms")
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, QUERY_KEY)


@BOOK.query("op7_html_blocks")
def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# Every count is without the document's own occurrences.
OP1_SQL = """
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from t),
q as (select *, lag(w) over (partition by doc_id order by i) as v from p),
o1 as (select doc_id, w, count(*) as own from p group by all),
c1 as (select w, sum(own) as c from o1 group by w),
u1 as (select doc_id, w, c - own as c from o1 join c1 using (w)),
o2 as (select doc_id, v, w, count(*) as own from q where v is not null group by all),
c2 as (select v, w, sum(own) as c from o2 group by all),
u2 as (select doc_id, v, w, c - own as c from o2 join c2 using (v, w)),
n as (select doc_id, count(*) as n, sum(count(*)) over () as total from p group by doc_id),
s as (select q.doc_id, coalesce(u2.c > 0, false) as seen,
             case when u2.c > 0 then ln(u2.c) - ln(b.c)
                  else ln(greatest(a.c, 1)) - ln(greatest(n.total - n.n, 1)) + case when q.v is null then 0 else ln(0.4) end end as s
      from q join n using (doc_id) join u1 a on a.doc_id = q.doc_id and a.w = q.w
      left join u1 b on b.doc_id = q.doc_id and b.w = q.v
      left join u2 on u2.doc_id = q.doc_id and u2.v = q.v and u2.w = q.w),
d as (select doc_id, count(*) as n_words, count(*) filter (where seen) as n_seen, sum(s) as score from s group by doc_id)
select t.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_seen, 0)::bigint as n_seen,
       round(coalesce(score, 0), 4) as score, round(score / n_words, 6) as per_word
from t left join d using (doc_id)
"""


@BOOK.query("op1_stupid_backoff", OP1_SQL)
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_seen", F.round("score", 4).alias("score"), F.round("per_word", 6).alias("per_word"))


@BOOK.query("op5_repeated_bytes")
def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@BOOK.query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors)
    error = whitening.identity_error(vectors, model)
    return whitening.whiten(vectors, model).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"))


def held_out(id: str = "doc_id"):
    """Whether a document is kept from training: a fifth of all, by the crc32 of its id; null ids are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(5)) == 0, F.lit(False))


@BOOK.query("op11_factor_quality")
def op11_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    scored = factor_quality.score_quality(docs, factor_quality.fit_factors(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the crc32 of its id, repeats one stretch of its words from some word on; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("bigint")
    n = F.size("_words").cast("bigint")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
    fresh = F.array_join(F.transform(at, lambda i: F.get("_words", i.cast("int"))), " ")
    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    planted = docs.withColumn("_words", F.when(chosen, words(F.col("text"))))  # other texts are not split
    return planted.select("doc_id", F.when(F.size("_words") > 0, fresh).otherwise(F.col("text")).alias("text"))


@BOOK.query("op12_dyadic_runs")
def op12_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = squares.find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.least")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.least")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
