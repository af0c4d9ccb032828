"""Lookups, overlays and upserts against a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

ACTION = "action"


def existing(df: DataFrame, target: DataFrame, key: str = "listing_id") -> DataFrame:
    return df.join(target.select(key), key, "left_semi")


def new_only(df: DataFrame, target: DataFrame, key: str = "listing_id") -> DataFrame:
    return df.join(target.select(key), key, "left_anti")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` plus the rows whose key it lacks."""
    return target.unionByName(new_only(rows, target, key), allowMissingColumns=True)


def _present(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return c != ""
    if isinstance(kind, T.NumericType):
        return c > 0
    return c.isNotNull()


def overlay(listings: DataFrame, details: DataFrame, key: str, columns: Iterable[str],
            guarded: bool = True, clean: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Details over listings by a left join on ``key``, unique in ``details``.

    ``clean`` has by column what is done to a detail that replaces.

    guarded    a detail replaces only when it says something: text that is not
               empty, a number above zero, any flag
    unguarded  whatever a detail row holds replaces, null meaning 'not given'
    """
    columns = list(columns)
    theirs = details.select(key, *[F.col(c).alias(f"__d_{c}") for c in columns])
    kinds = details.schema
    merged = {}
    for c in columns:
        new = F.col(f"__d_{c}")
        use = _present(new, kinds[c].dataType) if guarded else new.isNotNull()
        merged[c] = F.when(use, clean[c](new) if clean and c in clean else new).otherwise(F.col(c))
    return listings.join(theirs, key, "left").withColumns(merged).drop(*theirs.columns[1:])


def upsert(target: DataFrame, updates: DataFrame, key: str, now: str,
           ignore: Iterable[str] = ("src_seq", "job_id")) -> DataFrame:
    """``target`` after an upsert, with an ``action`` per row.

    Keys are unique on both sides; both sides are used more than once, so they
    should be stored tables. Every non-key column is replaced,
    ``created_at`` is kept, ``updated_at`` becomes ``now`` where a row changed.
    Actions: 'insert', 'update', 'unchanged' (same content) and 'keep' (no
    update for the key).

    The update of known rows and the insert of new ones are separate joins, so
    that a batch small enough to broadcast leaves the target unshuffled; a full
    outer join would shuffle all of it every time.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    content = [c for c in target.columns if c not in (key, "created_at", "updated_at")]
    compared = [c for c in content if c not in set(ignore)]
    new = updates.select(key, *[F.col(c).alias(f"__u_{c}") for c in content],
                         F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__u_{c}"))
    action = F.when(~hit, "keep").when(same, "unchanged").otherwise("update")
    known = (target.join(new, key, "left").withColumn(ACTION, action)
             .select(key, *[F.when(F.col(ACTION) == "update", F.col(f"__u_{c}"))
                            .otherwise(F.col(c)).alias(c) for c in content],
                     "created_at",
                     F.when(F.col(ACTION) == "update", stamp).otherwise(F.col("updated_at"))
                     .alias("updated_at"), ACTION))
    met = target.select(key).join(updates.select(key), key, "left_semi")
    added = (updates.join(met, key, "left_anti")
             .select(key, *content, F.coalesce("created_at", stamp).alias("created_at"),
                     stamp.alias("updated_at"), F.lit("insert").alias(ACTION)))
    return known.unionByName(added)


def fold_in(held: DataFrame, rows: DataFrame, keys: list[str], order: list[str],
            ignore: Iterable[str] = ()) -> DataFrame:
    """``held`` after an upsert of ``rows``, several of which may be of one key, with ``action`` and ``rows`` (of the key).

    A key has the content of its row of greatest ``order``, whenever that came, and the least ``created_at`` if
    there is one; so upserts in any number and order end up with the same table. ``keys`` are unique in
    ``held``; null keys are one key. Actions: 'insert', 'update', 'unchanged' (a later row of the same content but
    for ``ignore`` and the times), 'stale' (rows older than what is held) and 'keep'.
    """
    content = [c for c in held.columns if c not in (*keys, "created_at")]
    times = ["created_at"] if "created_at" in held.columns else []
    last = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*content), F.struct(*order)).alias("__new"), F.count("*").alias("rows"),
        *[F.min(c).alias(f"__{c}") for c in times])
    old = held.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*content, *times).alias("__old"))
    same_key = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same_key = test if same_key is None else same_key & test
    new, was = F.col("__new"), F.col("__old")
    later = F.struct(*[new[c] for c in order]) > F.struct(*[was[c] for c in order])
    same = F.lit(True)
    for c in content:
        if c not in {*order, *ignore, "updated_at"}:
            same = same & new[c].eqNullSafe(was[c])
    action = (F.when(new.isNull(), "keep").when(was.isNull(), "insert").when(~later, "stale")
              .when(same, "unchanged").otherwise("update"))
    takes = F.col(ACTION).isin("insert", "update", "unchanged")
    return old.join(last, same_key, "full_outer").withColumn(ACTION, action).select(
        *[F.when(new.isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        *[F.when(takes, new[c]).otherwise(was[c]).alias(c) for c in content],
        *[F.least(F.col(f"__{c}"), was[c]).alias(c) for c in times],
        ACTION, F.coalesce("rows", F.lit(0)).alias("rows"))


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy(ACTION).agg(F.count("*").alias("n"))


def patch(target: DataFrame, changes: DataFrame, key: str, allowed: Iterable[str]) -> DataFrame:
    """Partial updates limited to ``allowed`` columns; null means 'leave as is'."""
    columns = [c for c in allowed if c in changes.columns and c in target.columns]
    if not columns:
        return target
    return overlay(target, changes, key, columns, guarded=False).select(*target.columns)


def _matches(where: Mapping[str, object]) -> Column:
    if not where:
        raise ValueError("refusing to match every row: give at least one column")
    test = F.lit(True)
    for name, value in where.items():
        test = test & F.col(name).eqNullSafe(F.lit(value))
    return test


def update_where(df: DataFrame, values: Mapping[str, object],
                 where: Mapping[str, object]) -> DataFrame:
    """The table after ``UPDATE ... WHERE`` by equality."""
    test = _matches(where)
    kinds = df.schema
    return df.withColumns({
        c: F.when(test, F.lit(v).cast(kinds[c].dataType)).otherwise(F.col(c))
        for c, v in values.items()})


def delete_where(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    return df.filter(~_matches(where))


def affected(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    return df.agg(F.count_if(_matches(where)).alias("affected"))
