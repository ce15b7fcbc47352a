"""Vector layers: attribute filters, scale-dependent rules, bound symbolizer values, sub-layer unions, groups.

A filter's literal takes the column's type: against a number a literal that is none is false (true for "not
equal"), and a null value is false for every test but "is null".
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(literal) -> float | None:
    try:
        return float(literal)
    except (TypeError, ValueError):
        return None


def compare(column: Column, kind: str, op: str, literal) -> Column:
    """kind: the column's type, "text" or "number"; op: = <> < > <= >=."""
    n = _number(literal)
    if kind == "number":
        if n is None:
            return F.coalesce(column.isNotNull(), F.lit(False)) if op == "<>" else F.lit(False)
        left, right = column.cast("double"), F.lit(n)
    else:
        left, right = column, F.lit(str(literal))
    test = {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
    return F.coalesce(test, F.lit(False))


def between(column: Column, kind: str, low, high) -> Column:
    """Half open: low <= value < high."""
    return compare(column, kind, ">=", low) & compare(column, kind, "<", high)


def like(column: Column, pattern: str, wildcard: str = "%", single: str = "_", escape: str = "\\") -> Column:
    """Text alone, ASCII case-insensitive, with characters of choice for any run, any one and escape."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif ch == wildcard:
            out += ".*"
        elif ch == single:
            out += "."
        else:
            out += re.escape(ch)
        i += 1
    return F.coalesce(column.rlike(f"(?is)^{out}$"), F.lit(False))


def is_null(column: Column) -> Column:
    return column.isNull()


def first_rule(rules: Sequence[tuple[str, Column | None, float | None, float | None]], scale: float, otherwise: str | None = None) -> Column:
    """The name of the first rule whose filter holds, of those for min <= scale < max; else the else-rule's."""
    out = None
    for name, test, low, high in rules:
        if (low is not None and scale < low) or (high is not None and scale >= high):
            continue
        test = F.lit(True) if test is None else test
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def bound(column: str | None, default, columns: Sequence[str]) -> Column:
    """A symbolizer value bound to a column, if the layer has it, else the default."""
    if column is None or column.lower() not in {c.lower() for c in columns}:
        return F.lit(default)
    return F.coalesce(F.col(column), F.lit(default))


def sublayers(*parts: DataFrame) -> DataFrame:
    """Distinct union of topology or network sub-layers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def overlay(layers: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Of each cell the values of the layer painted last."""
    # a buffer for each value and none of a struct: numbers then stay in a hash table and are not sorted
    return layers.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def stacked(cells: DataFrame, keys: Sequence[str], layers: Sequence[tuple[int, Column | None, Sequence[Column]]], values: Sequence[str]) -> DataFrame:
    """Of each cell the values of the layer painted last, of layers (paint order, test or None, values) over one table with a row per cell.

    Nothing is grouped or shuffled, so memory doesn't grow with the cells.  Cells that no layer shows are left out.
    """
    top = None
    for _, test, columns in sorted(layers, key=lambda x: x[0], reverse=True):
        test, shown = F.lit(True) if test is None else test, F.struct(*[v.alias(n) for v, n in zip(columns, values, strict=True)])
        top = F.when(test, shown) if top is None else top.when(test, shown)
    return cells.select(*keys, top.alias("top")).where("top is not null").select(*keys, "top.*")


def spread(features: DataFrame, *columns: str) -> DataFrame:
    """Features dealt out by a hash of columns: their files are small, so that what one feature costs or grows to would else be up to a task or two.

    Equal rows alone meet in one task; one key with many different rows does not.
    """
    return features.repartition(F.xxhash64(*columns))
