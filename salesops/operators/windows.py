"""Row picking per group: ``ROW_NUMBER() ... = 1`` and loose ``GROUP BY``.

``pick_one`` keeps one row per key under a stated order.  It is written as
``row_number() over (partition by keys order by ...) = 1``; Catalyst plans that
as a partial ``WindowGroupLimit`` before the shuffle and a final one after, so
each map task sends at most one row per key and a hot key (even a third of
the table) cannot overload one reducer.  NULL keys form one group, as in SQL.

The reports leave ties open (``ORDER BY posting_date DESC`` only) and use
loose ``GROUP BY bd`` that returns values of an arbitrary row; every pick here
ends its order with a unique column so results are deterministic, which also
makes recomputation after a lost executor give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def _sort(c: Column | str) -> Column:
    return F.col(c).asc_nulls_first() if isinstance(c, str) else c


def row_number_in(df: DataFrame, keys: Sequence[str], order: Order, name: str = "rn") -> DataFrame:
    """Add ``row_number() over (partition by keys order by order)``."""
    w = Window.partitionBy(*keys).orderBy(*[_sort(c) for c in order])
    return df.withColumn(name, F.row_number().over(w))


def row_number_by_levels(df: DataFrame, key: str, levels: Sequence[str], rest: Order, name: str = "rn") -> DataFrame:
    """``row_number()`` per ``key``, ordered by the ``levels`` descending (NULLs
    last) and then ``rest``, without putting a key into one task.

    Rows are ranked among those alike in key and all levels.  From the last level
    to the first, the counts of the greater values (one row per value) set the
    ranks off, so a key is spread over its values of all levels together.
    NULL keys form one group, as in SQL.
    """
    ranked = row_number_in(df, [key, *levels], rest, name).withColumn(name, F.col(name).cast("bigint"))
    counts = df.groupBy(key, *levels).agg(F.count(F.lit(1)).alias("__n"))
    offset = None
    for depth in range(len(levels), 0, -1):
        group, own = [key, *levels[:depth - 1]], levels[depth - 1]
        at = counts.groupBy(*group, own).agg(F.sum("__n").alias("__n"))
        ahead = Window.partitionBy(*group).orderBy(F.col(own).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        at = at.select(*group, own, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias(f"__o{depth}"))
        offset = at if offset is None else _null_safe(offset, at, [*group, own])
    ahead = sum((F.col(f"__o{d}") for d in range(1, len(levels) + 1)), F.lit(0))
    return _null_safe(ranked, offset, [key, *levels]).withColumn(name, F.col(name) + ahead).select(*df.columns, name)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on ``keys``, NULL equal to NULL; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def row_number_split(df: DataFrame, key: str, levels: Sequence[str], rest: Order, name: str = "rn",
                     hot_rows: int = 1_000_000) -> DataFrame:
    """``row_number()`` per ``key`` (NULL a key of its own), ordered by the
    ``levels`` descending and then ``rest``; keys of more than ``hot_rows`` rows
    are ranked level by level, the others in one window."""
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(key)
    plain = row_number_in(_null_safe(df, hot, [key], "left_anti"), [key], [*[F.col(c).desc_nulls_last() for c in levels], *rest], name)
    split = row_number_by_levels(_null_safe(df, hot, [key], "left_semi"), key, levels, rest, name)
    return plain.withColumn(name, F.col(name).cast("bigint")).unionByName(split)


def pick_one(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per ``keys``: the first under ``order``."""
    tmp = "__pick_rn"
    return row_number_in(df, keys, order, tmp).where(F.col(tmp) == 1).drop(tmp)


def latest_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[str], tie_break: Sequence[str] = ("name",)) -> DataFrame:
    """Latest row per key: ``by`` descending (NULLs last), then ``tie_break`` descending."""
    order = [F.col(c).desc_nulls_last() for c in list(by) + [t for t in tie_break if t not in by]]
    return pick_one(df, keys, order)


def one_row_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Loose ``GROUP BY keys`` made deterministic: the first row under ``order``."""
    return pick_one(df, keys, order)
