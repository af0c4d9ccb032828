"""First-wins dedupe, caps and numbering that stand hot keys.

A key may hold a third of all rows, so rows are reduced before they are
shuffled: aggregates combine map-side, rank filters become group limits, and
numbering splits rows into even order ranges first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROW = "__row"


def dedupe_key(name: Column, organization: Column) -> Column:
    org = F.coalesce(F.nullif(organization, F.lit("")), F.lit("unknown"))
    return F.lower(F.concat_ws("-", name, org))


def _pick(df: DataFrame, keys: list, order: list, pick, **extra: Column) -> DataFrame:
    order_by = F.struct(*order) if len(order) > 1 else order[0]
    named = {k for k in keys if isinstance(k, str)}
    grouping = [F.col(k) if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[c for c in df.columns if c not in named] or [F.lit(True)])
    best = df.groupBy(*grouping).agg(pick(row, order_by).alias(_ROW),
                                     *[c.alias(n) for n, c in extra.items()])
    columns = [F.col(c) if c in named else F.col(_ROW).getField(c).alias(c) for c in df.columns]
    return best.select(*columns, *extra)


def dedupe_first(df: DataFrame, keys: list[Column | str], order: list[Column],
                 **extra: Column) -> DataFrame:
    """The row with the least ``order`` of each key; ``extra`` adds aggregates.

    One aggregation with map-side combine: a hot key leaves each map task as a
    single row. ``order`` must tell rows of a key apart for a repeatable result.
    A key that is a column of ``df`` should be given by its name: it stays the
    grouping column then, so a join on it that follows needs no second shuffle.
    """
    return _pick(df, keys, order, F.min_by, **extra)


def keep_latest(df: DataFrame, keys: list[Column | str], order: list[Column],
                **extra: Column) -> DataFrame:
    return _pick(df, keys, order, F.max_by, **extra)


def cap(df: DataFrame, n: int, order: list[Column], by: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows, overall or per group.

    Per group Spark turns the rank filter into a group limit that runs before
    the shuffle, so at most ``n`` rows per group leave a map task.
    """
    if by is None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def _slice_of(df: DataFrame, order: str, slices: int) -> Column:
    """How many of the quantiles of ``order`` lie below a row, by binary search."""
    shares = [i / slices for i in range(1, slices)] or [0.5]
    limits = sorted(set(df.agg(F.percentile_approx(order, shares, 10 * slices)).first()[0] or ()))
    steps = max(1, len(limits).bit_length())
    padded = F.array(*map(F.lit, limits + [None] * (2 ** steps - 1 - len(limits))))
    halves = F.array(*[F.lit(2 ** k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(
        F.get(padded, at + step - 1) < F.col(order), step).otherwise(0))


def number_rows(df: DataFrame, order: str, by: list[str], name: str = "row_no",
                slices: int | None = None) -> DataFrame:
    """1, 2, 3 ... within each group by a unique numeric ``order`` column.

    Rows are cut into ``slices`` ranges at quantiles of ``order`` over all groups,
    so a range has about an equal share of the rows, however the values lie, and
    no group has more of it. Rows are numbered per group and range and shifted by
    the size of the ranges before. The limits, at most ``slices`` numbers, are
    fetched first: both branches of the plan use the same ones. There are four slices per shuffle partition
    unless said otherwise, 1024 at most.
    """
    if slices is None:
        slices = min(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = df.withColumn("__slice", _slice_of(df, order, slices))
    keys = [*by, "__slice"]
    sizes = sliced.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(c).alias(f"__{c}") for c in keys],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(order)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]      # a group may be null
    return (sliced.withColumn("__at", F.row_number().over(inside))
            .join(shifts, same)
            .withColumn(name, F.col("__before") + F.col("__at"))
            .select(*df.columns, name))


def batch_numbers(df: DataFrame, order: str, by: list[str], size: int,
                  name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows within each group, from 0."""
    return (number_rows(df, order, by, "__no")
            .withColumn(name, F.floor((F.col("__no") - 1) / size)).drop("__no"))
