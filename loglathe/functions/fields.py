"""Reading values out of a record's open field map.

``fields`` is ``MAP<STRING, VARIANT>``: one JSON parse keeps the key order of the
record (a plain VARIANT object sorts its keys) and the JSON type of every value
(a string map would lose ``30`` vs ``"30"``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed

FIELDS_TYPE = "map<string,variant>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times while computing it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(values: Column) -> Column:
    """First non-NULL item of an array, or NULL."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def key_array(keys: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys])


def empty_fields() -> Column:
    return F.from_json(F.lit("{}"), FIELDS_TYPE)


def parse_object(text: Column) -> Column:
    """JSON object text -> field map; NULL unless the text is one ``{…}`` object.

    The last of several equal keys wins, as JSON readers usually do.
    """
    parsed = F.from_json(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), FIELDS_TYPE)
    return let(parsed, lambda p: F.when(
        F.size(F.array_distinct(F.map_keys(p))) == F.size(p), p
    ).otherwise(last_wins(F.map_entries(p))))


def last_wins(entries: Column) -> Column:
    """Key/value entries -> map; for a repeated key the value of the last entry is kept.

    Like assignment into a dictionary, the key stays where it first appeared.
    """
    def unique(all_entries: Column) -> Column:
        keys = F.transform(all_entries, lambda e: e["key"])
        firsts = F.filter(all_entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        backwards = F.reverse(keys)
        return F.map_from_entries(F.transform(
            firsts,
            lambda e: F.struct(
                e["key"].alias("key"),
                F.get(
                    all_entries,
                    (F.size(all_entries) - F.array_position(backwards, e["key"])).cast("int"),
                )["value"].alias("value"),
            ),
        ))
    return let(entries, unique)


def squash_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def kind(value: Column) -> Column:
    """JSON type name of a variant: STRING, BIGINT, DECIMAL(p,s), DOUBLE, OBJECT<…>, …"""
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    return value.cast("string")


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def is_number(value: Column) -> Column:
    return kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_scalar(value: Column) -> Column:
    """A string or a number."""
    return kind(value).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_object(value: Column) -> Column:
    return kind(value).startswith("OBJECT")


def is_array(value: Column) -> Column:
    return kind(value).startswith("ARRAY")


def present(value: Column) -> Column:
    """There and not a JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def string_at(fields: Column, key: str) -> Column:
    """The value when it is a string, else NULL."""
    return let(fields[key], lambda v: F.when(v.isNotNull() & is_string(v), text(v)))


def object_at(fields: Column, key: str) -> Column:
    """A nested object as a field map, else NULL."""
    return let(fields[key], lambda v: F.when(v.isNotNull() & is_object(v), v.cast(FIELDS_TYPE)))


# Texts that may stand for something other than a JSON string. Only for these is the typed
# value looked at: reading a VARIANT costs far more than reading a text.
_NOT_SURELY_SCALAR = r"^(?:true$|false$|[{\[])"
_NOT_SURELY_STRING = r"^(?:true$|false$|[{\[]|-?[0-9][0-9.eE+\-]*$)"


class Cells(NamedTuple):
    """A record's values as text, next to the typed map they came from."""

    texts: Column
    typed: Column

    def held(self, keys: Sequence[str]) -> Column:
        """Those of the keys that the record has, in the order of ``keys``."""
        return F.array_intersect(key_array(keys), F.map_keys(self.texts))

    def first(self, keys: Sequence[str], value: Callable[[Column], Column]) -> Column:
        """First non-NULL ``value`` of a held key."""
        return first_of(F.transform(self.held(keys), value))

    def shown(self, key: Column) -> Column:
        """The value as text unless it is an empty string; NULL when missing or null."""
        t = self.texts[key]
        return F.when(t != "", t)

    def scalar(self, key: Column) -> Column:
        """A non-empty string, or a number as text, else NULL."""
        t = self.texts[key]
        return F.when((t != "") & (~t.rlike(_NOT_SURELY_SCALAR) | is_scalar(self.typed[key])), t)

    def string(self, key: Column) -> Column:
        t = self.texts[key]
        return F.when(~t.rlike(_NOT_SURELY_STRING) | is_string(self.typed[key]), t)

    def integer(self, key: Column) -> Column:
        t = self.texts[key]
        whole = t.rlike("^-?[0-9]{1,18}$") & (kind(self.typed[key]) == "BIGINT")
        return F.when(whole, t).cast("bigint")


TEXTS, META_TEXTS, META_FIELDS = "_texts", "_meta_texts", "_meta_fields"


def with_cells(records: DataFrame) -> DataFrame:
    """Add the text views of a record and of its ``_meta`` object (NULL without one)."""
    return (
        records.withColumns({
            TEXTS: texts_of(F.col("fields")),
            META_FIELDS: object_at(F.col("fields"), fixed.META_KEY),
        })
        .withColumn(META_TEXTS, texts_of(F.col(META_FIELDS)))
    )


def field_of(keys: Sequence[str]) -> Column:
    """First key holding a non-empty string or a number; then the same keys in ``_meta``."""
    top = Cells(F.col(TEXTS), F.col("fields"))
    meta = Cells(F.col(META_TEXTS), F.col(META_FIELDS))
    return F.coalesce(top.first(keys, top.scalar), meta.first(keys, meta.scalar))


def settle(records: DataFrame, *names: str) -> DataFrame:
    """Compute columns once, here.

    Catalyst moves a filter below a projection by copying the projected expressions into it,
    over and over for staged ones. A one-row ``inline`` is a step it does not move across.
    """
    rest = [c for c in records.columns if c not in names]
    return records.select(*rest, F.inline(F.array(F.struct(*names))))


def texts_of(fields: Column) -> Column:
    """Every value as text: strings bare, objects and arrays as JSON, null as NULL."""
    return F.transform_values(fields, lambda _, v: text(v))


def one_line(value: Column) -> Column:
    return squash_ends(F.regexp_replace(value, r"\s+", " "))
