"""Dictionaries and arrays of a document as map and array columns of lexemes.

Null dictionaries and arrays stay null; entries with null values count as not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.strings import name_column


def get(held: Column, key: str) -> Column:
    """The value of a key, or null."""
    return F.try_element_at(held, F.lit(key))


def drop(held: Column, *keys: str) -> Column:
    return F.map_filter(held, lambda k, _: ~k.isin(*keys))


def put(held: Column, key: str, value: Column) -> Column:
    """With a key set; a null value takes it away."""
    rest = drop(held, key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def with_stream(held: Column, data: Column) -> Column:
    """The dictionary of a stream: its length is that of the data."""
    return put(held, "/Length", F.octet_length(data).cast("string"))


def merged(old: Column, new: Column) -> Column:
    """Both dictionaries; where they share a key the new one counts."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def items(held: Column) -> Column:
    """Entries with a value, in order of their keys."""
    return F.array_sort(F.map_entries(F.map_filter(held, lambda _, v: v.isNotNull())))


def written(held: Column) -> Column:
    """A dictionary as written on one line."""
    return F.concat(F.lit("<<"), F.array_join(F.transform(items(held), lambda e: F.concat(name_column(e["key"]), F.lit(" "), e["value"])), " "), F.lit(">>"))


def count_of(array: Column, value: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def index_of(array: Column, value: Column) -> Column:
    """Place of the first such element from 0; null if there is none."""
    return F.nullif(F.array_position(array, value), F.lit(0)) - 1


def without_first(array: Column, value: Column) -> Column:
    at = F.array_position(array, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(array, F.lit(1), at - 1), F.slice(array, at + 1, F.size(array)))).otherwise(array)


def without_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))
