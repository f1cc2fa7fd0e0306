"""The token index: every token made once, ranges that follow each other, few bytes of disk for a row."""

import os
import random
from bisect import bisect_right
from collections import Counter
from datetime import date, datetime
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from cratewise.operators import catalog as cat, token_runs as tr
from cratewise.session import checkpoint_folder


def test_tokens_are_made_once_for_bounds_and_rows(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(id):
        made.add(1)
        return None if id is None else [f"t{(id * k) % 97:02d}" for k in range(id % 5)]

    ids = [*range(200), 7, None]
    keys = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", tokens("id").alias("tokens"))
    rows = cat.token_index(keys).withColumn("part", F.spark_partition_id()).collect()
    assert made.value == len(ids)
    assert sorted((r["token"], r["id"]) for r in rows) == sorted((f"t{(i * k) % 97:02d}", i) for i in ids if i is not None for k in range(i % 5))
    own = [(r["token"], r["id"]) for r in sorted(rows, key=lambda r: r["part"])]  # a stable sort: rows of a range stay in order
    assert own == sorted(own)


def exchanged(plan) -> int:
    """Bytes that the shuffles of a plan that ran have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged(plan.plan())
    metrics, below = plan.metrics(), plan.children()
    own = metrics.apply("shuffleBytesWritten").value() if metrics.contains("shuffleBytesWritten") else 0
    return own + sum(exchanged(below.apply(k)) for k in range(below.size()))


def kept_bytes(spark) -> int:
    folder = checkpoint_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)


def in_order(rows) -> list:
    return sorted(rows, key=lambda row: tuple((x is not None, x) for x in row))


def by_part(index) -> list:
    """(token, id) rows in the order of their ranges, as they lie there, and how many ranges have rows."""
    rows = index.withColumn("part", F.spark_partition_id()).collect()
    return [(r["token"], r["id"]) for r in sorted(rows, key=lambda r: r["part"])], len({r["part"] for r in rows})


def test_a_row_takes_few_bytes_of_disk(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [[rng.choice(words) for _ in range(300)] for _ in range(400)]
    docs = [(i, list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))) for i, w in enumerate(texts)]
    keys = spark.createDataFrame(docs, "id bigint, tokens array<string>").coalesce(2)
    before = kept_bytes(spark)
    index = cat.token_index(keys)
    ran = index._jdf.queryExecution()
    count = ran.toRdd().count()
    used = exchanged(ran.executedPlan()) + kept_bytes(spark) - before
    print(f"bytes of disk a row: {used / count:.1f}")
    assert used < 17 * count
    got, parts = by_part(index)
    assert got == in_order((t, i) for i, tokens in docs for t in tokens) and len(got) == count and parts > 1


def test_a_common_token_is_spread_by_id_and_equal_rows_stay(spark):
    keys = (spark.range(200_000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 120_000).alias("id"), F.expr(
        "case when id % 7 = 0 then null when id % 7 = 1 then array() else array('the', null, 'the') end").alias("tokens")))
    want = [(t, i % 120_000 if i % 9 else None) for i in range(200_000) if i % 7 > 1 for t in ("the", None, "the")]
    got, parts = by_part(cat.token_index(keys))
    assert got == in_order(want) and parts > 1
    assert by_part(cat.token_index(keys.limit(0))) == ([], 0)


def test_ids_may_be_texts(spark):
    keys = spark.createDataFrame([("b", ["é", "z", ""]), (None, ["z"]), ("ä", ["z"]), ("a", ["z", "\U0001f600", "\uffee"])], "id string, tokens array<string>")
    got, _ = by_part(cat.token_index(keys))
    assert got == in_order([("é", "b"), ("z", "b"), ("", "b"), ("z", None), ("z", "ä"), ("z", "a"), ("\U0001f600", "a"), ("\uffee", "a")])


def test_ids_and_tokens_of_other_types(spark):
    for kind, ids in (("struct<a:int>", [(3,), (1,), None]), ("double", [0.5, float("nan"), None]), ("date", [date(2020, 1, 2), date(2019, 1, 2), None]),
                      ("timestamp", [datetime(2020, 1, 2, 3), datetime(2019, 1, 2, 3), None])):
        keys = spark.createDataFrame([(i, ["b", "a"]) for i in ids], f"id {kind}, tokens array<string>")
        got, _ = by_part(cat.token_index(keys))
        low, high = (ids[1], ids[0]) if kind != "double" else (ids[0], ids[1])
        assert str(got) == str([(t, spark.createDataFrame([(i,)], f"id {kind}").first()["id"]) for t in "ab" for i in (None, low, high)])
    got, _ = by_part(cat.token_index(spark.createDataFrame([(1, [10, 9])], "id bigint, tokens array<int>")))
    assert got == [(9, 1), (10, 1)]


def test_small_runs_cut_at_any_bounds_give_the_same_rows(monkeypatch):
    monkeypatch.setattr(tr, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    for name, value in (("RUN_BYTES", 2000), ("CHUNK_ROWS", 7), ("MARK_BYTES", 300), ("OUT_ROWS", 5)):
        monkeypatch.setattr(tr, name, value)
    rng = random.Random(3)
    docs = [(rng.choice([None, *range(20)]), rng.choice([None, rng.choices([None, "", "a", "ab", "b c", "zz"], k=rng.randint(0, 9))])) for _ in range(300)]
    rows = [(t, i) for i, tokens in docs for t in tokens or []]
    table = pa.table({"id": pa.array([i for i, _ in docs], pa.int64()), "tokens": pa.array([t for _, t in docs], pa.list_(pa.string()))})
    runs = list(tr._sorted_runs(iter(table.to_batches(max_chunksize=120))))
    marks = [(m["token"], m["id"]) for r in runs for m in r.column("marks").flatten().to_pylist()]
    weight = sum(tr.ROW_BYTES + len(t or "") for t, _ in rows)
    assert set(marks) <= set(rows) and abs(len(marks) - weight / 300) < len(marks) / 5
    for bounds in ([], in_order(rng.sample(marks, 9)), in_order([*rng.sample(rows, 30), ("", -1), ("aa", 3), ("zzz", 1), (None, None)])):
        edges = pa.table({"token": pa.array([t for t, _ in bounds], pa.string()), "id": pa.array([i for _, i in bounds], pa.int64())})
        slices = pa.Table.from_batches(tr._cut(edges)(iter(runs))).combine_chunks().to_batches()
        order = [tr._order(None if t is None else t.encode(), i) for t, i in bounds]
        got = Counter()
        for batch in slices:
            for part, piece in zip(batch.column("part").to_pylist(), batch.column("rows")):
                one = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([piece.as_py()], pa.binary())], names=["part", "rows"])
                found = [tuple(r.values()) for b in tr._merged(iter([one])) for r in b.to_pylist()]
                assert found and all(bisect_right(order, tr._order(None if t is None else t.encode(), i)) == part for t, i in found)
                got.update(found)
        assert got == Counter(rows)
        merged = [tuple(r.values()) for b in tr._merged(iter(slices)) for r in b.to_pylist()]
        assert merged == in_order(rows)
