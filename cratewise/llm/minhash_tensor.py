"""Near duplicates by minhash tables with tensored keys, confirmed on full shingle sets.

Two small collections of half keys (``rows`` minhashes each) are computed per
text, and the key of table (i, j) combines half key i of the first with half
key j of the second: ``half * half`` tables from ``2 * half * rows`` minhashes.
A pair of similarity s shares a table with probability
``(1 - (1 - s**rows) ** half) ** 2``; 0.99998 at 0.85 with the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.components import connected_components
from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import mix, slices, text_shingles

SEED = 20_11


def _minhashes(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The least value of each set under ``count`` hashed orders; (sets, count)."""
    draws = np.random.default_rng(SEED).integers(0, 1 << 63, (2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(offsets) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    starts = offsets[:-1][full]
    with np.errstate(over="ignore"):
        for k in range(count):
            x = values * draws[0, k]
            x ^= x >> np.uint64(32)
            x *= draws[1, k]
            out[full, k] = np.minimum.reduceat(x, starts)
    return out


def signatures(docs: DataFrame, *, text: str = "text", size: int = 5, half: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set and the half keys of each row."""
    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, first array<bigint>, second array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            values, offsets = text_shingles(batch.column("text"), size)
            sizes = np.diff(offsets)
            low = _minhashes(values, offsets, 2 * half * rows).reshape(len(sizes), 2 * half, rows)
            keys = np.zeros((len(sizes), 2 * half), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    keys = mix(keys * np.uint64(31) + low[:, :, r])
                digest = [np.concatenate([[0], np.cumsum(mix(values + np.uint64(k)))]).astype(np.uint64) for k in (1, 2)]
                sums = [d[offsets[1:]] - d[offsets[:-1]] for d in digest]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).view(np.int64).ravel()), half)
                     .cast(pa.list_(pa.int64())) for k in (keys[:, :half], keys[:, half:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums], *lists],
                names=["doc_id", "n_shingles", "set_a", "set_b", "first", "second"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(work, schema)


def shared_sizes(pairs: DataFrame, texts: DataFrame, *, size: int = 5) -> DataFrame:
    """Add ``shared`` and ``joint`` (sizes of intersection and union of full sets) to pairs a, b.

    ``texts`` has id and text. A text travels once per pair; the set of a text
    that many pairs of a batch name is made once.
    """
    schema = "a bigint, b bigint, shared bigint, joint bigint"
    both = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 2 << 20):
            sets = []
            for name in ("text_a", "text_b"):
                coded = batch.column(name).dictionary_encode()
                values, offsets = text_shingles(coded.dictionary, size)
                sets.append((coded.indices.to_numpy(zero_copy_only=False), values, offsets))
            (at_a, va, oa), (at_b, vb, ob) = sets
            shared, joint = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, (i, j) in enumerate(zip(at_a, at_b)):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[j]:ob[j + 1]]
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared[k] = int((y[at] == x).sum()) if len(y) else 0
                joint[k] = len(x) + len(y) - shared[k]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared), pa.array(joint)],
                                             names=["a", "b", "shared", "joint"])

    return both.mapInArrow(work, schema)


def near_duplicates(docs: DataFrame, *, text: str = "text", size: int = 5, percent: int = 85, half: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts with equal shingle sets are collapsed to the least id first, so large
    groups of copies cost one row. In each table, every text is compared with
    one holder of its key only, the one that meets most others over all tables;
    the copies of a text are near to it. Those that do not reach ``percent``
    there are compared, in a second step, with the other holders of the key
    that they could still reach: what two sets share inside the first holder's
    set is at most the lesser of what each shares with it, and what they share
    outside is at most the lesser of what each has there that any other set
    has too. The bound is taken for the key's first holder and for the most
    central set that both were compared with. It is exact, and members already
    joined are left out.

    Null and empty texts have no shingles and are linked with nothing; they and
    rows without an id are kept. Rows that repeat an id are one document.
    """
    signed = stored(signatures(docs, text=text, size=size, half=half, rows=rows), "signatures")
    sets = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
                  .agg(F.min("doc_id").alias("id"), F.first("first").alias("first"), F.first("second").alias("second")), "sets")
    keys = _table_keys(sets)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Stored (a, b, shared, joint) of pairs of distinct ids."""
        needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        held = joined_small(texts, needed, ["id"], "left_semi")
        return stored(shared_sizes(pairs, held, size=size).groupBy("a", "b").agg(
            F.max_by(F.struct("shared", "joint"), F.col("shared") / F.col("joint")).alias("s")).select("a", "b", "s.*"), "confirmed")

    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = stored(keys.join(held, "key"), "met")
    central = met.groupBy("id").agg(F.sum("held").alias("met"))
    lead = met.join(central, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("i"), "n")).alias("c"))
    star = stored(met.join(lead, "key").select("key", "id", "n", (-F.col("c.i")).alias("lead"), F.col("c.n").alias("lead_n")), "stars")
    pairs = stored(star.where("id <> lead").where(_sizes_allow("n", "lead_n", percent))
                   .select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    tested = confirm(pairs)
    good = F.expr(f"100 * shared >= {percent} * joint")
    joined = stored(connected_components(tested.where(good)), "components")

    # Second step: holders of a key that are not joined with its first holder.
    placed = (star.join(tested.select(F.col("a").alias("id"), F.col("b").alias("lead"), "shared"), ["id", "lead"], "left")
              .join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    lead_component = joined.select(F.col("id").alias("lead"), F.col("component").alias("lead_component"))
    placed = stored(placed.join(lead_component, "lead", "left").where("id <> lead")
                    .withColumn("apart", F.col("component") != F.coalesce("lead_component", "lead")), "placed")
    open_keys = placed.groupBy("key").agg(F.max("apart").alias("open"), F.count(F.lit(1)).alias("held")).where("open and held > 1").select("key")
    around = stored(placed.join(open_keys, "key", "left_semi"), "around")
    # The most central of all sets that a member was compared with; most members of a large group have the same.
    main = (tested.join(central.select(F.col("id").alias("b"), "met"), "b").groupBy("a")
            .agg(F.max(F.struct("met", (-F.col("b")).alias("i"), "shared")).alias("m"))
            .select(F.col("a").alias("id"), (-F.col("m.i")).alias("main"), F.col("m.shared").alias("main_shared")))
    around = stored(around.join(main, "id", "left"), "around")
    members = around.select("id").union(around.select("lead")).union(around.select("main").where("main is not null")).distinct()  # so that what is held by no other lies outside the first holder's set
    again = sets.groupBy("id").count().where("count > 1").select("id")  # an id with several texts has no part of its own
    own = _held_by_no_other(joined_small(texts, members, ["id"], "left_semi"), size).join(again, "id", "left_anti")
    around = around.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    around = stored(around.select("key", "id", "n", "component", "apart", "main", "main_shared", (F.col("n") - F.col("own")).alias("reach"),
                                  F.coalesce("shared", F.col("n") - F.col("own")).alias("inside"),
                                  F.when(F.col("shared").isNull(), F.col("n") - F.col("own"))
                                  .otherwise(F.col("n") - F.col("own") - F.col("shared")).alias("outside")), "around")
    # A set whose own part alone keeps it below the similarity can link to nothing.
    able = around.where(f"{100 + percent} * reach >= {percent} * (n + reach)")

    def pairs_of(rows: DataFrame, on: str, bound: str, also: str) -> DataFrame:
        """Pairs of rows equal in ``on``, in other components, that the bound allows."""
        x, y = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "xy")
        return (x.where("apart_x").join(y, F.col(f"{on}_x") == F.col(f"{on}_y"))
                .where("id_x <> id_y and component_x <> component_y and (not apart_y or id_x < id_y)").where(also)
                .where(f"{100 + percent} * least({bound}, reach_x, reach_y) >= {percent} * (n_x + n_y)")
                .select(F.col("id_x").alias("a"), F.col("id_y").alias("b")))

    # Sets with the same central set meet once by it, whatever the number of tables they share; the others by their keys.
    main_component = joined.select(F.col("id").alias("main"), F.col("component").alias("main_component"))
    by_main = (able.where("main is not null").select("id", "n", "component", "main", "main_shared", "reach").distinct()
               .join(main_component, "main", "left")
               .withColumn("apart", F.col("component") != F.coalesce("main_component", "main")).drop("main_component"))
    central_pairs = pairs_of(by_main, "main", "least(main_shared_x, main_shared_y) + least(reach_x - main_shared_x, reach_y - main_shared_y)", "true")
    other_pairs = pairs_of(able, "key", "least(inside_x, inside_y) + least(outside_x, outside_y)", "coalesce(main_x <> main_y, true)")
    more = central_pairs.unionByName(other_pairs).distinct()
    more = stored(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        tested = tested.unionByName(confirm(more))
        joined = stored(connected_components(tested.where(good)), "components")
    classes = sets.select("set_a", "set_b", "n_shingles", "id").join(joined, "id", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return (signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _held_by_no_other(texts: DataFrame, size: int) -> DataFrame:
    """(id, own): how many shingles of each text no other text of these has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            values, offsets = text_shingles(batch.column("text"), size)
            owner = np.repeat(batch.column("id").to_numpy(), np.diff(offsets))
            found, first, counts = np.unique(values, return_index=True, return_counts=True)
            several = pa.array(counts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(owner[first]), several], names=["mark", "id", "several"])

    seen = texts.mapInArrow(work, "mark bigint, id bigint, several boolean").groupBy("mark").agg(
        F.count(F.lit(1)).alias("times"), F.max("several").alias("several"), F.max("id").alias("id"))
    return seen.where("times = 1 and not several").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _sizes_allow(a: str, b: str, percent: int):
    """Sets whose sizes differ too much cannot reach the similarity."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _table_keys(sets: DataFrame) -> DataFrame:
    """(key, id, n) of every table in which a set can meet another one.

    A table key is shared only if both half keys are, so half keys held by one
    set alone are left out before pairs of half keys are formed.
    """
    halves = (sets.select("id", F.col("n_shingles").alias("n"), F.explode(F.concat(
        F.transform("first", lambda v, i: F.struct(F.lit(0).alias("side"), i.alias("i"), v.alias("v"))),
        F.transform("second", lambda v, i: F.struct(F.lit(1).alias("side"), i.alias("i"), v.alias("v"))))).alias("h"))
        .select("id", "n", F.col("h.side").alias("side"), F.col("h.i").alias("i"), F.col("h.v").alias("v")))
    often = halves.groupBy("side", "i", "v").agg(F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    kept = halves.join(often, ["side", "i", "v"]).groupBy("id", "n").agg(
        F.collect_list(F.when(F.col("side") == 0, F.struct("i", "v"))).alias("first"),
        F.collect_list(F.when(F.col("side") == 1, F.struct("i", "v"))).alias("second"))
    pairs = kept.select("id", "n", F.explode("first").alias("x"), "second").select("id", "n", "x", F.explode("second").alias("y"))
    return stored(pairs.select(F.xxhash64("x.i", "y.i", "x.v", "y.v").alias("key"), "id", "n"), "keys")
