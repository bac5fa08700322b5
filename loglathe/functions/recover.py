"""Per-value helpers Spark has no function for: strict JSON checks and loose JSON recovery.

Both run as Arrow-batched UDFs and are only given candidate values; all else is NULL.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.functions import fixed
from loglathe.functions.fields import parse_object

_KEY = re.compile(r'\s*"((?:[^"\\]|\\.)*)"\s*:\s*', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[\[{]|[\]}]|,(?=\s*")', re.S)


# A type object: this module is also imported by workers, where no session parses DDL.
_RECOVERED = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("partial", T.BooleanType())
])


def _reject_constant(name: str):
    raise ValueError(name)


def strict_json(value: str):
    return json.loads(value, parse_constant=_reject_constant)


def is_json(value: str) -> bool:
    """Valid JSON, with NaN and Infinity allowed as the level-counting rules allow them."""
    try:
        json.loads(value)
    except (ValueError, RecursionError):
        return False
    return True


def _value_end(body: str, start: int) -> int:
    """Where a top-level value ends: at a comma outside brackets that a quote follows."""
    depth = 0
    for token in _TOKEN.finditer(body, start):
        mark = token.group()[0]
        if mark in "[{":
            depth += 1
        elif mark in "]}":
            depth -= 1
        elif mark == "," and depth <= 0:
            return token.start()
    return len(body)


def loose_pairs(value: str) -> dict:
    """Top-level ``"key": value`` pairs of a damaged object; unreadable values stay text."""
    close = value.rfind("}")
    if close < 1:
        return {}
    body, at, found = value[1:close], 0, {}
    while match := _KEY.match(body, at):
        end = _value_end(body, match.end())
        raw = body[match.end():end].strip()
        try:
            found[re.sub(r"\\(.)", r"\1", match.group(1), flags=re.S)] = strict_json(raw)
        except (ValueError, RecursionError):
            found[re.sub(r"\\(.)", r"\1", match.group(1), flags=re.S)] = raw
        at = end + 1
    return found


def recover_object(value: str) -> tuple[dict | None, bool]:
    """The object a text stands for and whether it is only a partial reading."""
    value = value.strip()
    if len(value) < 2 or value[0] != "{":
        return None, False
    try:
        return strict_json(value), False
    except (ValueError, RecursionError):
        pairs = loose_pairs(value)
        return (pairs, True) if pairs else (None, False)


def _open_inside(item, depth: int):
    if depth >= fixed.RECOVER_MAX_DEPTH:
        return item
    if isinstance(item, str):
        found, _ = recover_object(item)
        return item if found is None else _open_inside(found, depth + 1)
    if isinstance(item, dict):
        return {k: _open_inside(v, depth + (not isinstance(v, str))) for k, v in item.items()}
    return item


@F.pandas_udf(_RECOVERED)
def recover_text(values: pd.Series) -> pd.DataFrame:
    rows = []
    for value in values:
        found, partial = recover_object(value) if value is not None else (None, False)
        body = None if found is None else json.dumps(_open_inside(found, 1), ensure_ascii=False)
        rows.append((body, partial if found is not None else None))
    return pd.DataFrame(rows, columns=["body", "partial"])


@F.pandas_udf(T.BooleanType())
def any_not_json(values: pd.Series) -> pd.Series:
    """Whether any text of an array is not valid JSON."""
    return pd.Series(
        [None if items is None else any(not is_json(v) for v in items) for items in values]
    )


def looks_like_object(value: Column) -> Column:
    return value.rlike(r"^\s*\{")


def may_be_unexpanded(value: Column) -> Column:
    """Starts like JSON and has JSON punctuation; the strict check is still to come."""
    start = F.substring(F.regexp_replace(value, r"^\s+", ""), 1, 1)
    return start.isin("{", "[") & (value.contains('":') | value.contains('","'))


def recover_fields(records: DataFrame, source: str = "raw") -> DataFrame:
    """Records whose ``source`` text is an object, whole or damaged: ``fields`` and ``partial``.

    Valid objects are parsed natively; only the others go to the loose reader. Texts in which
    neither finds an object are left out.
    """
    text = F.col(source)
    # a string that holds JSON again is opened by the reader
    plain = F.try_parse_json(text).isNotNull() & ~text.rlike(r'"\s*[\[{]')
    read = records.filter(looks_like_object(text)).withColumn("_plain", plain).withColumn(
        "_r", recover_text(F.when(~F.col("_plain"), text)))
    opened = read.withColumns({
        "partial": F.when(F.col("_plain"), F.lit(False)).otherwise(F.col("_r.partial")),
        "_text": F.when(F.col("_plain"), text).otherwise(F.col("_r.body")),
    }).filter("_text IS NOT NULL")
    return opened.withColumn("fields", parse_object(F.col("_text"))).drop("_text", "_plain", "_r")
