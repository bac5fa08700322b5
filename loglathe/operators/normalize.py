"""Search-index exports: lift what the export wrapped into ``_meta`` back to the top.

Top-level fields win over the original event's fields, and those over other ``_meta``
fields. ``@timestamp`` becomes ``timestamp`` when that is missing; other ``@`` fields go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.fields import empty_fields, object_at
from loglathe.operators.rewrite import fill_gaps


def _cut_keys(fields: Column, prefix: str) -> Column:
    return F.transform_keys(fields, lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))


def _noise(key: Column) -> Column:
    return key.isin(*fixed.META_NOISE)


def _parts(fields: Column, nested: Column, original: Column) -> dict[str, Column]:
    """The five groups of fields, from the strongest to the weakest."""
    dotted_meta = F.map_filter(
        fields,
        lambda k, _: k.startswith(fixed.META_PREFIX)
        & ~k.startswith(fixed.ORIGINAL_PREFIX) & (k != fixed.META_PREFIX),
    )
    return {
        "_base": F.map_filter(
            fields,
            lambda k, _: ~k.startswith(fixed.META_PREFIX) & (k != fixed.META_KEY) & ~k.startswith("@"),
        ),
        "_dotted_original": _cut_keys(F.map_filter(
            fields,
            lambda k, _: k.startswith(fixed.ORIGINAL_PREFIX) & (k != fixed.ORIGINAL_PREFIX),
        ), fixed.ORIGINAL_PREFIX),
        "_nested_original": F.coalesce(original, empty_fields()),
        "_dotted_meta": F.map_filter(
            _cut_keys(dotted_meta, fixed.META_PREFIX),
            lambda k, _: (k != fixed.ORIGINAL_KEY) & ~_noise(k),
        ),
        # A scalar event_original is lifted from the nested form, dropped from the dotted one.
        "_nested_meta": F.map_filter(
            F.coalesce(nested, empty_fields()),
            lambda k, _: ~_noise(k) & ~((k == fixed.ORIGINAL_KEY) & original.isNotNull()),
        ),
        "_stamp": F.map_filter(
            F.transform_keys(
                F.map_filter(fields, lambda k, _: k == "@timestamp"), lambda k, _: F.lit("timestamp")
            ),
            lambda _, v: v.isNotNull() & ~F.is_variant_null(v),
        ),
    }


def normalize_export(records: DataFrame) -> DataFrame:
    """Rewrite ``fields`` of records that carry ``_meta.…`` keys, a ``_meta`` object or an
    ``@timestamp`` / ``@version``; all others stay as they are."""
    f, nested, original = F.col("fields"), F.col("_nested"), F.col("_original")
    out = (
        records.withColumn("_nested", object_at(f, fixed.META_KEY))
        .withColumn("_original", object_at(nested, fixed.ORIGINAL_KEY))
        .withColumn("_is_export", nested.isNotNull() | F.exists(
            F.map_keys(f),
            lambda k: k.startswith(fixed.META_PREFIX) | k.isin("@timestamp", "@version"),
        ))
        .withColumn("_g", F.when(F.col("_is_export"), F.struct(*[
            c.alias(n) for n, c in _parts(f, nested, original).items()
        ])))
    )
    lifted = F.col("_g")["_base"]
    for name in ("_dotted_original", "_nested_original", "_dotted_meta", "_nested_meta", "_stamp"):
        lifted = fill_gaps(lifted, F.col("_g")[name])
    return out.withColumn("fields", F.when(F.col("_is_export"), lifted).otherwise(f)).drop(
        "_nested", "_original", "_is_export", "_g"
    )
