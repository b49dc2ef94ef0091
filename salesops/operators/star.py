"""The dashboard's achievement star without the product.

The dashboard joins four achievement tables to each business developer on
``bd`` alone, keeps the product rows where any child's own date test holds,
and takes ``MAX`` of per-child ``CASE ... ELSE 0`` values.  Per developer that
product has W x D x M x Q rows; at scale it does not fit anywhere.

The same numbers come from one aggregation per child.  For child x let
``P_x`` be its branch of the filter and ``v`` one of its values:

* ``hit_x``   = some row of x satisfies ``P_x``;
* ``all_v``   = max of v over all rows of x (0 when x has no rows: the
  NULL-extended row takes ``ELSE 0``);
* ``match_v`` = max of v over rows of x satisfying ``P_x``.

A developer survives when any child hits.  If some *other* child hits, every
row of x meets a surviving partner, so the result is ``all_v``; otherwise only
x's own hits survive and the result is ``match_v``.

A row whose value condition fails only adds 0 to ``all_v``.  So each child is
read within the date span that holds its filter and its condition (pushed to
the scan).  Whether it has any other row matters only for keys whose maximum
inside is negative or NULL and of which the span shows no other row; that is asked
of the two columns key and date, for these keys alone and for all children in one
pass: a semi join with the keys that ask drops the rows before they are shuffled,
and adaptive execution leaves the pass out where no key asks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """One achievement table: its filter branch, its value condition, the
    values (name -> Column, each evaluated as ``CASE WHEN cond THEN v ELSE 0``)
    and a span: a predicate on the date that every row of branch or condition
    satisfies (None: read all rows)."""

    name: str
    df: DataFrame
    pred: Column
    cond: Column
    values: Mapping[str, Column]
    span: Column | None = None


def child_stats(child: Child, key: str = "bd") -> DataFrame:
    """Per key, of the rows in the span: ``hit``, the maxima ``in`` (inside the condition) and ``match`` of every
    value, and whether it has ``some`` rows inside and any ``out``side."""
    n = child.name
    near = child.df if child.span is None else child.df.where(child.span)
    inside = F.coalesce(child.cond, F.lit(False))
    aggs = [F.max(F.coalesce(child.pred, F.lit(False)).cast("int")).alias(f"{n}_hit")]
    for vname, v in child.values.items():
        aggs.append(F.max(F.when(inside, v)).alias(f"{n}_in_{vname}"))
        aggs.append(F.max(F.when(child.pred, F.when(inside, v).otherwise(F.lit(0)))).alias(f"{n}_match_{vname}"))
    aggs.append((F.count_if(inside) > 0).alias(f"{n}_some"))
    aggs.append((F.count_if(~inside) > 0).alias(f"{n}_out"))
    return near.groupBy(key).agg(*aggs)


def _outside(child: Child, key: str) -> DataFrame:
    """Keys of the child's rows outside its condition, with its name."""
    return child.df.where(~F.coalesce(child.cond, F.lit(False))).select(F.col(key).alias("__star_o"), F.lit(child.name).alias("__star_c"))


def star_max(keys: DataFrame, children: Sequence[Child], key: str = "bd") -> DataFrame:
    """``keys`` (one row per key) with, per child value, the dashboard's MAX.

    Keys with no hit in any child are dropped.  Output columns are those of
    ``keys`` plus ``{child}_{value}``.
    """
    out = keys
    for ch in children:
        out = out.join(child_stats(ch, key), key, "left")
    hit = {ch.name: F.coalesce(F.col(f"{ch.name}_hit") == 1, F.lit(False)) for ch in children}
    out = out.where(reduce(Column.__or__, hit.values()))
    # the 0 of a row outside the condition shows where a maximum inside is negative or NULL
    asks = []
    for ch in children:
        if ch.span is not None:
            low = reduce(Column.__or__, [F.coalesce(F.col(f"{ch.name}_in_{v}") < 0, F.lit(True)) for v in ch.values])
            asks.append(F.when(low & F.col(f"{ch.name}_some") & ~F.col(f"{ch.name}_out"), F.lit(ch.name)))
    other = {ch.name: F.lit(False) for ch in children}
    if asks:
        asked = out.select(F.col(key).alias("__star_k"), F.explode(F.array_compact(F.array(*asks))).alias("__star_n"))
        outside = reduce(DataFrame.unionByName, [_outside(ch, key) for ch in children if ch.span is not None])
        met = outside.join(asked, (F.col("__star_o") == F.col("__star_k")) & (F.col("__star_c") == F.col("__star_n")), "left_semi")
        found = met.groupBy("__star_o").agg(F.collect_set("__star_c").alias("__star_f"))
        out = out.join(found, F.col(key) == F.col("__star_o"), "left")
        other = {ch.name: F.coalesce(F.array_contains("__star_f", ch.name), F.lit(False)) for ch in children}
    cols = [F.col(c) for c in keys.columns]
    for ch in children:
        n = ch.name
        other_hit = reduce(Column.__or__, [h for m, h in hit.items() if m != n], F.lit(False))
        alone = F.col(f"{n}_some") & ~F.col(f"{n}_out") & ~other[n]
        for vname in ch.values:
            top = F.col(f"{n}_in_{vname}")
            all_v = F.when(F.col(f"{n}_hit").isNull(), F.lit(0)).when(alone, top).otherwise(F.greatest(top, F.lit(0)))
            cols.append(F.when(other_hit, all_v).otherwise(F.col(f"{n}_match_{vname}")).alias(f"{n}_{vname}"))
    return out.select(*cols)
