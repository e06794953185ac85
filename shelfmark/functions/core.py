"""Small building blocks shared by the column builders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Inside higher-order functions Spark does not share subexpressions, so a
    long regexp chain used three times would run three times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value: object, schema: str) -> Column:
    """A nested constant, written as one literal so that the plan stays small.

    Catalyst folds it to a value once; a tree of one node per entry would be
    walked by every analysis and optimizer rule.
    """
    return F.from_json(F.lit(json.dumps(value)), schema)


def strings(values: Iterable[str]) -> Column:
    return constant(list(values), "array<string>")


def string_map(entries: dict[str, str]) -> Column:
    return constant(entries, "map<string,string>")


def list_map(entries: dict[str, list[str]]) -> Column:
    return constant(entries, "map<string,array<string>>")


def no_strings() -> Column:
    return F.expr("CAST(array() AS array<string>)")


def strip(c: Column | str) -> Column:
    """Drop leading and trailing whitespace of any kind, not only spaces."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or only whitespace."""
    return F.coalesce(strip(c), F.lit("")) == ""


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(col(c), F.lit(""))
