"""Small numeric column helpers with pinned rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def half_up(col: Column) -> Column:
    """Round half towards +infinity, as a BIGINT."""
    return F.floor(col + F.lit(0.5))


def round6(col: Column) -> Column:
    """Six decimals, half up, written so that any engine gives the same double."""
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def clamp01(col: Column) -> Column:
    return clamp(col, 0.0, 1.0)


def log2(col: Column) -> Column:
    return F.log2(col)


def fold_range(value: Column, low: float, high: float) -> Column:
    """Double until >= low, then halve until <= high, however far the value lies outside.

    Closed form: the number of doublings is ceil(log2(low) - log2(value)). log2
    can be off by an ulp exactly at a power of two, so both edges are re-tested.
    Values that no doubling brings into the range (zero, negative, infinite) stay.
    """
    def scaled(x: Column, n: Column) -> Column:
        """x * 2^n in two steps, since 2^n alone may be beyond a double."""
        half = F.floor(n / 2)
        return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), n - half)

    def corrected(n: Column, fits) -> Column:
        def tested(n: Column) -> Column:
            return F.when((n > 0) & fits(n - 1), n - 1).when(fits(n), n).otherwise(n + 1)
        return bound(F.greatest(F.lit(0), n).cast("int"), tested)

    def lowered(x: Column) -> Column:
        downs = corrected(F.ceil(log2(x) - log2(F.lit(high))), lambda n: scaled(x, -n) <= F.lit(high))
        return bound(downs, lambda n: scaled(x, -n))

    def folded(x: Column) -> Column:
        ups = corrected(F.ceil(log2(F.lit(low)) - log2(x)), lambda n: scaled(x, n) >= F.lit(low))
        fits = F.when((x >= low) & (x <= high), x)  # most values need no step
        lifted = bound(ups, lambda n: scaled(x, n))
        return fits.when((x > 0) & (x < float("inf")), bound(lifted, lowered)).otherwise(x)

    return bound(value, folded)


def bound(col: Column, use) -> Column:
    """``use(x)`` with x the value of ``col``, computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use many times, computed once per row.

    Stacked projections are merged by the optimiser, which copies an expression
    into every use; a one-row generator in between keeps it a plain column.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
