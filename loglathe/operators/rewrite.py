"""Record rewrites: field map in, field map out. All of them are plain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.fields import (
    FIELDS_TYPE, empty_fields, is_array, is_object, is_string, last_wins, let, object_at,
    parse_object, string_at, text,
)

ANSI_PATTERN = r"\x1B\[[0-?]*[ -/]*[@-~]"


def strip_ansi(value: Column) -> Column:
    """Remove terminal escape sequences (``ESC [ … final``)."""
    return F.regexp_replace(value, ANSI_PATTERN, "")


def without_keys(fields: Column, keys: Column) -> Column:
    return F.map_filter(fields, lambda k, _: ~F.array_contains(keys, k))


def fill_gaps(fields: Column, more: Column) -> Column:
    """``fields``, plus those entries of ``more`` whose keys are not there yet."""
    return let(fields, lambda f: F.map_concat(f, without_keys(more, F.map_keys(f))))


def expand_message(records: DataFrame) -> DataFrame:
    """A ``message`` holding a JSON object is replaced by the object's fields.

    An inner ``message`` wins; any other outer field wins over an inner one.
    """
    f = F.col("fields")
    outer = F.map_filter(f, lambda k, _: k != "message")
    return (
        records.withColumn("_inner", parse_object(string_at(f, "message")))
        .withColumn("fields", F.when(
            F.col("_inner").isNotNull(), fill_gaps(outer, F.col("_inner"))
        ).otherwise(f))
        .drop("_inner")
    )


def is_noise_key(key: Column) -> Column:
    """Fields that describe the infrastructure a record came from."""
    return key.startswith("kubernetes_") | key.startswith("container_") | (key == "service_instance")


def strip_k8s(records: DataFrame) -> DataFrame:
    """Fold infrastructure fields into ``_meta`` (what is already there stays).

    A record whose ``_meta`` is not an object is left alone.
    """
    f, noise, meta = F.col("fields"), F.col("_noise"), F.col("_folded")
    rest = F.map_filter(f, lambda k, _: ~is_noise_key(k) & (k != fixed.META_KEY))
    folded = F.map_from_arrays(
        F.array(F.lit(fixed.META_KEY)),
        F.array(F.to_variant_object(fill_gaps(F.coalesce(meta, empty_fields()), noise))),
    )
    blocked = F.array_contains(F.map_keys(f), fixed.META_KEY) & meta.isNull()
    return (
        records.withColumns({
            "_noise": F.map_filter(f, lambda k, _: is_noise_key(k)),
            "_folded": object_at(f, fixed.META_KEY),
        })
        .withColumn("fields", F.when(
            (F.size(noise) == 0) | blocked, f
        ).otherwise(F.map_concat(rest, folded)))
        .drop("_noise", "_folded")
    )


# --- SQL arguments -----------------------------------------------------------
def sql_literal(value: Column) -> Column:
    """Strings quoted with quotes doubled, null as NULL, other values as they are."""
    quoted = F.concat(F.lit("'"), F.replace(text(value), F.lit("'"), F.lit("''")), F.lit("'"))
    return (
        F.when(value.isNull() | F.is_variant_null(value), "NULL")
        .when(is_string(value), quoted)
        .otherwise(text(value))
    )


def bind_args(sql: Column, args: Column) -> Column:
    """Replace every ``$N`` by the N-th argument; an unknown ``$N`` stays.

    The text is cut at the placeholders and put together once, so a ``$1`` inside a bound
    value is never bound again.
    """
    literals = F.transform(args, sql_literal)
    marks = F.regexp_extract_all(sql, F.lit(r"(\$\d+)"), F.lit(1))
    bound = F.transform(
        marks,
        lambda m: F.coalesce(
            F.get(literals, F.substr(m, F.lit(2)).try_cast("int") - 1), m
        ),
    )
    glued = F.zip_with(
        F.split(sql, r"\$\d+", -1), bound, lambda piece, b: F.concat(piece, F.coalesce(b, F.lit("")))
    )
    return F.array_join(glued, "")


def args_of(fields: Column) -> Column:
    """``args`` as an array: a JSON array, or a string holding one; else NULL."""
    return let(fields["args"], lambda args: F.when(
        args.isNotNull(),
        F.when(is_array(args), args.cast("array<variant>")).when(
            is_string(args), F.from_json(text(args), "array<variant>")
        ),
    ))


def bind_sql(records: DataFrame) -> DataFrame:
    """Put the values of ``args`` into the SQL fields of each record."""
    f, args = F.col("fields"), F.col("_args")
    bound = F.transform_values(
        f,
        lambda k, v: F.when(
            k.isin(*fixed.QUERY_KEYS) & v.isNotNull() & is_string(v),
            let(text(v), lambda sql: bind_args(sql, args)).cast("variant"),
        ).otherwise(v),
    )
    return (
        records.withColumn("_args", args_of(f))
        .withColumn("fields", F.when(args.isNotNull(), bound).otherwise(f))
        .drop("_args")
    )


# --- nesting -----------------------------------------------------------------
def flatten_fields(fields: Column) -> Column:
    """Nested objects -> dotted keys; arrays stay whole; the later of equal keys wins.

    However deep: a record has at most as many levels as opening braces, and a level that is
    already flat passes the rest of them through.
    """
    nested = lambda entries: F.exists(
        entries, lambda e: e["value"].isNotNull() & is_object(e["value"]))
    braces = F.length(F.regexp_replace(F.to_json(F.to_variant_object(fields)), r"[^{]", ""))
    levels = F.sequence(F.lit(1), F.greatest(braces, F.lit(1)))
    entries = F.aggregate(
        levels, F.map_entries(fields),
        lambda all_entries, _: F.when(nested(all_entries), F.flatten(F.transform(all_entries, _open_entry)))
        .otherwise(all_entries))
    return let(entries, last_wins)


def _open_entry(entry: Column) -> Column:
    value = entry["value"]
    inner = F.transform(
        F.map_entries(value.cast(FIELDS_TYPE)),
        lambda i: F.struct(
            F.concat(entry["key"], F.lit("."), i["key"]).alias("key"), i["value"].alias("value")
        ),
    )
    return F.when(value.isNotNull() & is_object(value), inner).otherwise(F.array(entry))


def flatten(records: DataFrame) -> DataFrame:
    return records.withColumn("fields", flatten_fields(F.col("fields")))


def frames(records: DataFrame, key: str = "frames") -> DataFrame:
    """One row per frame (``idx, location, function``) or inner exception (``idx, type, message``)."""
    items = F.col("fields")[key]
    opened = F.when(items.isNotNull() & is_array(items), items.cast("array<variant>"))
    at = lambda name: F.try_variant_get(F.col("_item"), f"$.{name}", "string")
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    rest = [c for c in records.columns if c != "fields"]
    exploded = records.select(*rest, F.posexplode(opened).alias("idx", "_item"))
    if key == "frames":
        parts = [
            F.concat_ws(":", some(at("file"), "?"), some(at("line"), "?")).alias("location"),
            some(at("function"), "").alias("function"),
        ]
    else:
        parts = [some(at("type"), "?").alias("type"), some(at("message"), "").alias("message")]
    return exploded.select(*rest, "idx", *parts)


def unescape_sql(json_text: Column) -> Column:
    r"""``\n`` and ``\t`` of a JSON-encoded SQL value become real characters.

    An escaped backslash keeps guarding what follows it. For text sinks only: the result is
    no longer strict JSON.
    """
    guard = "\x00"
    out = F.replace(json_text, F.lit("\\\\"), F.lit(guard))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\\t"), F.lit("\t"))
    return F.replace(out, F.lit(guard), F.lit("\\\\"))


_SQL_PIECE = r'"(?i:sql|query|statement|query_text)"\s*:\s*"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*"|[^"]+|"'
_SQL_START = r'^"(?i:sql|query|statement|query_text)"\s*:\s*"'


def readable_sql(json_text: Column) -> Column:
    """``unescape_sql`` in the values of SQL keys (any case) of a JSON text, all else as it is."""
    pieces = F.regexp_extract_all(json_text, F.lit(_SQL_PIECE), F.lit(0))
    return F.array_join(F.transform(
        pieces, lambda p: F.when(p.rlike(_SQL_START), unescape_sql(p)).otherwise(p)), "")
