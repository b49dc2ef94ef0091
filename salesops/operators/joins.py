"""Join operators.

No join here forces a broadcast: the inputs that look small on the test data
(plans, developers, sales persons) grow with the business, so the choice is
left to adaptive execution, which broadcasts a side only after measuring its
real shuffle size (``spark.sql.adaptive.autoBroadcastJoinThreshold``) and
otherwise keeps the sort-merge join, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``LEFT JOIN right ON right.k = left.k WHERE right.k IS NULL`` as a real anti join.

    A NULL ``left_key`` matches nothing, so the row stays, as in the SQL form.
    The right side is reduced to its distinct keys first (a partial
    aggregation), so a key holding a large share of ``right`` becomes one row
    before the shuffle: the build side of an anti join cannot be split by
    adaptive skew handling, so it must not carry the skew.
    """
    r = right.select(F.col(right_key).alias("__anti_k")).where(F.col("__anti_k").isNotNull()).distinct()
    return left.join(r, F.col(left_key) == F.col("__anti_k"), "left_anti")


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left`` rows with a matching key in ``right`` (right reduced to distinct keys)."""
    r = right.select(F.col(right_key).alias("__semi_k")).where(F.col("__semi_k").isNotNull()).distinct()
    return left.join(r, F.col(left_key) == F.col("__semi_k"), "left_semi")


def not_in_subquery(df: DataFrame, column: str, values: DataFrame, value_column: str, key: bool = False) -> DataFrame:
    """``df.column NOT IN (SELECT value_column FROM values)`` with SQL semantics.

    The row stays when the list is empty; otherwise only when ``column`` is not
    NULL, the list holds no NULL and no list value equals it.  One left join
    with the distinct list values marks the members, so the list may be of any
    size and ``df`` is read once, and one three-valued predicate decides.  Whether
    the list holds a NULL is one look with an ``IS NULL`` filter that reaches its
    scan; whether it is empty matters only for rows whose own value is NULL and
    is asked by one row.  ``key``: the column is a key without NULLs, which saves
    the second look.  The predicate holds the marker, so the optimizer cannot
    copy the looks through later joins.
    """
    v = values.select(F.col(value_column).alias("__nin_v"))
    is_null = F.col("__nin_v").isNull()
    nulls = v.where(is_null).agg(F.count(F.lit(1))).scalar()
    members = v.where(~is_null).distinct().withColumn("__nin_hit", F.lit(True))
    c = F.col(column)
    marked = df.join(members, c == F.col("__nin_v"), "left")
    stays = F.col("__nin_hit").isNull() & (nulls == 0)
    if not key:
        some = v.limit(1).agg(F.count(F.lit(1))).scalar()
        stays = stays & (c.isNotNull() | (some == 0))
    return marked.where(stays).drop("__nin_v", "__nin_hit")


def left_join_split(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, parts: int = 64) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` for a small ``left`` and a
    ``right`` in which one key may hold a large share of the rows.

    Adaptive execution splits only the streamed side of a left join, so a hot
    right-hand key would be one task.  Here each right-hand key is dealt into
    ``parts`` by a hash of the row, and every left row meets all of them (it is
    repeated ``parts`` times, which costs little for a small side).  Left rows
    without a partner are found by the distinct keys of the right side and kept
    once.  The dealt rows are shuffled once: the keys are taken from the same
    exchange, which is why their aggregation asks for all columns.
    Columns of the two sides must differ.
    """
    key = "__ls_key"
    part = F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int")
    # both filters are stated, as the join would add its own below one of the two uses of the exchange
    dealt = right.withColumn(key, right_key).withColumn("__ls_part", part).where(F.col(key).isNotNull() & F.col("__ls_part").isNotNull())
    dealt = dealt.repartition(key, "__ls_part")
    keyed = left.withColumn("__ls_left", left_key)
    spread = keyed.withColumn("__ls_of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = spread.join(dealt, (F.col("__ls_left") == F.col(key)) & (F.col("__ls_of") == F.col("__ls_part")))
    keys = dealt.groupBy(key).agg(F.max(F.xxhash64(*right.columns, "__ls_part")).alias("__ls_any")).where("__ls_any is not null").select(key)
    alone = keyed.join(keys, F.col("__ls_left") == F.col(key), "left_anti")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return met.select(*left.columns, *right.columns).unionByName(alone.select(*left.columns, *none))


def disjunctive_left_joins(rows: DataFrame, key_cols: Sequence[str], targets: Sequence[tuple]) -> DataFrame:
    """``rows LEFT JOIN t1 ON t1.key = k1 OR t1.key = k2 ... LEFT JOIN t2 ON ...``.

    A disjunctive condition has no equi-join key and plans as a nested-loop
    join.  Instead the work is done once on the distinct key tuples of
    ``rows``: for each target the tuple's distinct non-NULL keys are matched in
    one equi-join, and the matches are left-joined back to the tuples, so a
    tuple without a match carries one NULL row and one with several has a row
    for each combination, exactly as the chained OR joins do.  Nothing is
    gathered in lists.  The tuples are joined back to ``rows`` once (NULL-safe).

    All targets ask from the same shuffled tuples (an outer explode: a plain one
    would push a filter of its own below the shuffle and so compute ``rows`` anew
    for each target); ``rows`` is computed twice however many targets there are.

    ``targets``: ``(df, key_column, columns, prefix)``; target columns come
    out as ``{prefix}{column}``; ``key_cols`` of ``rows`` may be NULL.
    """
    keys = list(key_cols)
    tup = [f"__dj{i}" for i in range(len(keys))]
    tuples = rows.select(*[F.col(k).alias(t) for k, t in zip(keys, tup)]).distinct()
    out = tuples
    for i, (tdf, tkey, tcols, prefix) in enumerate(targets):
        own = [f"__dj{i}_{k}" for k in range(len(keys))]
        asked = tuples.select(*[F.col(t).alias(o) for t, o in zip(tup, own)],
                              F.explode_outer(F.array_distinct(F.array(*tup))).alias("__dj_k")).where(F.col("__dj_k").isNotNull())
        target = tdf.select(F.col(tkey).alias("__dj_t"), *[F.col(c).alias(prefix + c) for c in tcols])
        found = asked.join(target, F.col("__dj_k") == F.col("__dj_t")).drop("__dj_k", "__dj_t")
        out = out.join(found, [F.col(t).eqNullSafe(F.col(o)) for t, o in zip(tup, own)], "left").drop(*own)
    cond = [F.col(k).eqNullSafe(out[t]) for k, t in zip(keys, tup)]
    return rows.join(out, cond, "left").drop(*tup)


def disjunctive_left_join(rows: DataFrame, key_cols: Sequence[str], target: DataFrame, target_key: str,
                          target_cols: Sequence[str], prefix: str) -> DataFrame:
    """``rows LEFT JOIN target ON target.key = k1 OR target.key = k2 ...`` (one target)."""
    return disjunctive_left_joins(rows, key_cols, [(target, target_key, target_cols, prefix)])


def ci_key(c: Column | str) -> Column:
    """Case-insensitive join key (``LOWER(x)``)."""
    return F.lower(F.col(c) if isinstance(c, str) else c)
