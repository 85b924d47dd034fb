"""Column helpers for text, pairs and JSON.

Patterns run in Java's engine with (?dU): only a line feed ends a line and \\w, \\d, \\s
and \\b follow Unicode, as they do in the log grammars that these operators parse.
Absent groups and empty matches are NULL here; sinks write them as empty strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "(?dU)"


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group(c: Column, pattern: str, n: int = 1, flags: str = FLAGS) -> Column:
    return empty_to_null(F.regexp_extract(c, flags + pattern, n))


def matches(c: Column, pattern: str, flags: str = FLAGS) -> Column:
    return c.rlike(flags + pattern)


def pairs(c: Column, pattern: str, lower: bool = False) -> Column:
    """Map of all key=value matches; a repeated key keeps its place and its last value."""
    keys = F.regexp_extract_all(c, F.lit(FLAGS + pattern), F.lit(1))
    if lower:
        keys = F.transform(keys, F.lower)
    return F.map_from_arrays(keys, F.regexp_extract_all(c, F.lit(FLAGS + pattern), F.lit(2)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is evaluated once however often f names it."""
    return F.try_element_at(F.transform(F.array(c), f), F.lit(1))


def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def first_key(m: Column, names: tuple[str, ...]) -> Column:
    """The first of names that is a key of m."""
    return F.coalesce(*[F.when(F.map_contains_key(m, n), F.lit(n)) for n in names])


def without(m: Column, used: Column) -> Column:
    """The entries of m whose keys are not in the array used."""
    return F.map_filter(m, lambda k, _: ~F.array_contains(used, k))


def keys_of(*columns: Column) -> Column:
    """Array of those keys that are not NULL."""
    return F.filter(F.array(*columns), lambda k: k.isNotNull())


def quote(c: Column) -> Column:
    """A string as JSON text; only one that needs escapes goes through the JSON writer."""
    escaped = F.to_json(F.array(c))
    return F.when(c.rlike(r'["\\\x00-\x1f]'), F.substring(escaped, F.lit(2), F.length(escaped) - 2)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


SPLIT = "\ue001"


def groups(c: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that matches c from its start, as an array after one
    match; absent groups are empty. Only for values that match."""
    parts = SPLIT.join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(c, FLAGS + pattern + r"(?s:.*)\z", parts), SPLIT, -1)


def item(array: Column, n: int) -> Column:
    """The nth entry, from 1; NULL if empty."""
    return empty_to_null(F.try_element_at(array, F.lit(n)))


def quoted(m: Column) -> Column:
    """A map of strings as a map of JSON texts."""
    return F.transform_values(m, lambda _, v: quote(v))


def strict_object(c: Column) -> Column:
    """Map of VARIANT if c is one JSON object and nothing else, else NULL.

    The surrounding brackets turn the lenient reader into a strict one: text after the
    object, a cut-off object or single quotes leave no array of one object.
    """
    options = {"allowSingleQuotes": "false"}
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    as_text = F.from_json(wrapped, "array<map<string,string>>", options)
    ok = F.startswith(c, F.lit("{")) & (F.size(as_text) == 1)
    return F.when(ok, F.try_element_at(F.from_json(wrapped, "array<map<string,variant>>", options), F.lit(1)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_scalar(v: Column) -> Column:
    """Strings, numbers and booleans; neither null, list nor object."""
    return ~kind(v).rlike("^(VOID|ARRAY|OBJECT)")


def is_object(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("OBJECT"))


def as_text(v: Column) -> Column:
    """Text of a scalar; booleans are written with a capital."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(kind(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def whole_number(c: Column) -> Column:
    return F.when(c.rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(c).try_cast("int"))


def digits(c: Column) -> Column:
    """Integer of a string of digits alone."""
    return F.when(c.rlike(r"\A\d+\z"), c.try_cast("int"))


def fenced(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with column `name` = c, evaluated where it stands: the optimizer neither copies c
    into the columns above that read it nor pushes filters on it below. Without a fence a
    filter on one field of a parsed line would carry the whole parser along for each mention.

    The fence is a generator of one row for each row. It is deterministic, so filters on the
    other columns pass it and reach the scan."""
    held = df.withColumn(f"_{name}", c)
    return held.withColumn(name, F.explode(F.array(f"_{name}"))).drop(f"_{name}")
