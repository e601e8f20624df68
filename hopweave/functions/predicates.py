"""Compound predicates ``base--direction--aspect`` (either qualifier may be empty) as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "--"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compound(base: Column, direction: Column, aspect: Column) -> Column:
    """The predicate's name: the base alone if neither qualifier is given."""
    d, a = _or_empty(direction), _or_empty(aspect)
    return F.when((d == "") & (a == ""), base).otherwise(F.concat(base, F.lit(SEPARATOR), d, F.lit(SEPARATOR), a))


def is_compound(predicate: Column) -> Column:
    return F.contains(predicate, F.lit(SEPARATOR))


def base_of(predicate: Column) -> Column:
    return F.element_at(F.split(predicate, SEPARATOR, 3), 1)


def parts_of(predicate: Column) -> Column:
    """struct(base, direction, aspect); a missing or empty qualifier is null."""
    parts = F.split(predicate, SEPARATOR, 3)
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(F.get(parts, F.lit(0)).alias("base"), part(1).alias("direction"), part(2).alias("aspect"))


def strip_prefix(name: Column, prefix: str = "biolink:") -> Column:
    return F.replace(name, F.lit(prefix), F.lit(""))
