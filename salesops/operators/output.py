"""Report shaping: labelled columns, the total row, category order and union."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_FIELDTYPES = ("Currency", "Int", "Float", "Percent")


@dataclass(frozen=True)
class Field:
    """One report column: name, label and display type."""

    name: str
    label: str
    fieldtype: str = "Data"


def as_report(df: DataFrame, fields: Sequence[Field], keep_others: bool = True) -> DataFrame:
    """Attach ``{label, fieldtype}`` metadata to the named columns, listed ones first."""
    listed = [F.col(f.name).alias(f.name, metadata={"label": f.label, "fieldtype": f.fieldtype}) for f in fields]
    names = {f.name for f in fields}
    rest = [F.col(c) for c in df.columns if c not in names] if keep_others else []
    return df.select(*listed, *rest)


def columns_of(df: DataFrame) -> list[dict]:
    """The ``columns`` list of a report: fieldname, label, fieldtype."""
    out = []
    for f in df.schema.fields:
        md = f.metadata or {}
        out.append({"fieldname": f.name, "label": md.get("label", f.name), "fieldtype": md.get("fieldtype", "Data")})
    return out


def with_total_row(df: DataFrame, fields: Sequence[Field], label_column: str | None = None,
                   flag: str = "is_total", order: Sequence[Column | str] = ()) -> DataFrame:
    """Append the total row a report viewer adds: numeric field types summed
    (NULL counts 0), ``Percent`` averaged over all rows, the label column set
    to ``Total`` when it is text, other columns empty; ``flag`` marks it.

    One aggregation over ``GROUPING SETS ((all columns), ())``: the detail set
    returns each distinct report row with its number, which is expanded again,
    so equal rows stay as many as they were; the empty set is the total.  The
    report is computed once.  The aggregation loses the rows' order, so ``order``
    states it anew; the total comes last.
    """
    types = {f.name: f.fieldtype for f in fields}
    label_column = label_column or fields[0].name
    cols = df.columns
    numeric = [c for c in cols if types.get(c) in NUMERIC_FIELDTYPES]
    aggs = [F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__sum{i}") for i, c in enumerate(numeric)]
    g = df.groupingSets([cols, []], *cols).agg(*aggs)
    total = F.col("__gid") != 0
    g = g.withColumn("__copy", F.explode(F.when(total, F.array(F.lit(1).cast("bigint"))).otherwise(
        F.sequence(F.lit(1).cast("bigint"), F.col("__n")))))
    out: list[Column] = []
    for c in cols:
        if c in numeric:
            s = F.col(f"__sum{numeric.index(c)}")
            value = s / F.col("__n") if types[c] == "Percent" else s
            out.append(F.when(total, value).otherwise(F.col(c)).alias(c))
        elif c == label_column:
            out.append(F.when(total, F.lit("Total")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    rows = g.select(*out, total.alias(flag))
    return rows.orderBy(flag, *order) if order else rows


def category_rank(category: Column, order: Sequence[str]) -> Column:
    """``FIELD(category, 'a', 'b', ...)``: 1-based position, 0 when absent."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), category).cast("int"), F.lit(0))


def unpivot_categories(df: DataFrame, keys: Sequence[str], categories: Sequence[str],
                       measures: Sequence[str], column_of, cell_type: str = "decimal(38,9)") -> DataFrame:
    """Rows per category from one wide row: ``UNION ALL`` of the category
    branches computed by a single aggregate (``stack``).  ``column_of(category,
    measure)`` names the wide column holding that cell; cells are cast to one
    ``cell_type``."""
    n = len(categories)
    parts = []
    for cat in categories:
        parts.append(f"'{cat}'")
        parts.extend(f"CAST(`{column_of(cat, m)}` AS {cell_type})" for m in measures)
    expr = f"stack({n}, {', '.join(parts)}) AS (Category, {', '.join(measures)})"
    return df.select(*keys, F.expr(expr))
