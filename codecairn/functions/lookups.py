"""Small closed vocabularies as literals, so a lookup is a projection and never a join."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def quoted(value) -> str:
    """A Spark SQL literal for a string, integer or boolean."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def map_literal(table: Mapping) -> Column:
    """A constant map column; one expression, folded by the optimizer."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def array_literal(values: Iterable) -> Column:
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def pairs_literal(table: Mapping[str, str]) -> Column:
    """``array<struct<pos, key, label>>`` of a vocabulary, in its own order."""
    return F.expr("array(" + ", ".join(
        f"named_struct('pos', {i}, 'key', {quoted(k)}, 'label', {quoted(v)})"
        for i, (k, v) in enumerate(table.items())) + ")")


def lookup(key: Column, table: Mapping) -> Column:
    """Value of ``key`` in a vocabulary, null when absent."""
    return F.try_element_at(map_literal(table), key)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring; plain substring search, no regex."""
    out = F.lit(False)
    for word in words:
        out = out | col.contains(word)
    return out


def overlaps(parts: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(parts, array_literal(names))
