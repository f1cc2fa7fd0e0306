"""Order-dependent operators that never put a whole group in one task.

A window partitioned by a key sends every row of that key to one task, and an
unpartitioned window sends the table to one. The helpers here range-partition
by the full order instead, so a key that holds a third of the table is spread
like any other rows, and only one summary row per partition is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cratewise.session import cut_lineage

_PART = "_range_part"


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The placement is written once: the per-partition totals and the rows must
    # agree on it, and sampled range bounds may differ between two runs.
    return cut_lineage(df.repartitionByRange(n, *order)
                       .withColumn(_PART, F.spark_partition_id()))


def with_position(df: DataFrame, order: Sequence[Column], position: str = "pos",
                  running: dict[str, str] | None = None,
                  group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Number rows 0.. in ``order``, with exclusive running sums.

    ``running`` maps a value column to the name of the sum of that column over
    all earlier rows. With ``group`` both restart at the first row of a group;
    the group columns then lead the order.
    """
    running = running or {}
    order = [F.col(c) for c in group] + list(order)
    ranged = _ranged(df, order, partitions)
    totals = ranged.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v).alias(f"_s_{v}") for v in running])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        _PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_s0_{v}") for v in running])
    inside = Window.partitionBy(_PART).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), _PART).select(
        *[F.col(c) for c in df.columns],
        (F.row_number().over(inside) - 1 + F.col("_n0")).cast("bigint").alias(position),
        *[(F.coalesce(F.sum(v).over(earlier), F.lit(0)) + F.col(f"_s0_{v}")).alias(name)
          for v, name in running.items()])
    if not group:
        return out
    starts = out.groupBy(*[F.col(g).alias(f"_k_{g}") for g in group]).agg(
        F.min(position).alias("_p0"), *[F.min(n).alias(f"_g_{n}") for n in running.values()])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    return out.join(starts, same).select(
        *[F.col(c) for c in df.columns],
        (F.col(position) - F.col("_p0")).alias(position),
        *[(F.col(n) - F.col(f"_g_{n}")).alias(n) for n in running.values()])


def with_neighbour(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   values: dict[str, str], direction: str = "next",
                   partitions: int | None = None) -> DataFrame:
    """``lead``/``lag`` by one row inside a group of any size.

    ``values`` maps a column to the name of its neighbour's value. ``order``
    must be unique inside a group. Rows at partition edges take the value from
    the first (last) row of the next (previous) partition.
    """
    forward = direction == "next"
    keys = [F.col(c) for c in [*group, *order]]
    ranged = _ranged(df, keys, partitions)
    row = F.struct(*keys, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    inside = Window.partitionBy(_PART).orderBy(*keys)
    edges = ranged.groupBy(_PART).agg((F.min(row) if forward else F.max(row)).alias("_edge"))
    across = Window.orderBy(_PART)
    edges = edges.select(_PART, (F.lead if forward else F.lag)("_edge").over(across).alias("_over"))
    out = (ranged.withColumn("_near", (F.lead if forward else F.lag)(row).over(inside))
           .join(F.broadcast(edges), _PART)
           .withColumn("_near", F.coalesce("_near", "_over")))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("_near")[g])
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.when(same, F.col("_near")[f"_v{i}"]).alias(name)
                        for i, name in enumerate(values.values())])


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column per name of ``shares``): exact quantiles with linear interpolation, for groups of any size.

    Equal values are counted before they are shuffled, and ranks are running
    sums of the counts over a range partitioning, so no group is sorted or held
    in one task. Null values don't count; the result equals ``percentile``.
    """
    held = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_position(held, [F.col(value)], "_place", {"_c": "_before"}, group)
    totals = held.groupBy(*[F.col(g).alias(f"_t_{g}") for g in group]).agg(F.sum("_c").alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
    rows = ranked.join(totals, same)
    parts, out = [], []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(float(share))
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            holds = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
            parts.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{end}"))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return rows.groupBy(*group, "n").agg(*parts).select(*group, "n", *out)


def with_halo(df: DataFrame, position: str, chunk: int, before: int = 0, after: int = 0,
              chunk_col: str = "_chunk", core_col: str = "_core") -> DataFrame:
    """Cut a positioned series into chunks and copy edge rows to neighbours.

    A window over (series, chunk) then sees ``before``/``after`` rows beyond its
    core, so any frame no wider than the halo gives the same result as over the
    whole series; keep rows with ``core_col`` afterwards.
    """
    pos = F.col(position)
    low = F.floor(F.greatest(pos - after, F.lit(0)) / chunk)
    high = F.floor((pos + before) / chunk)
    return (df.withColumn(chunk_col, F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
            .withColumn(core_col, F.col(chunk_col) == F.floor(pos / chunk)))
