"""Metadata: maps of texts that travel with steps and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = "map<string,string>"


def entries(**values: Column | str | None) -> Column:
    """A map of these keys; texts are literals, and every value is kept as text (nulls too)."""
    parts = [F.lit(x) if x is None or isinstance(x, str) else x for pair in values.items() for x in pair]
    return (F.create_map(*[p.cast("string") for p in parts]) if parts else F.create_map()).cast(METADATA)


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; where both have a key, the right one's counts.  A null map is empty."""
    a, b = (F.coalesce(m, F.create_map().cast(METADATA)) for m in (left, right))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
