"""Filters and search over records that carry their axes. Every one is a single predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.axes import with_axes
from loglathe.functions.fields import is_string, text
from loglathe.functions.recover import any_not_json, may_be_unexpanded
from loglathe.operators.sizes import join_small


def filter_levels(records: DataFrame, levels: Sequence[str] = ()) -> DataFrame:
    """Keep records of the named levels (trimmed, any case); no names keep everything."""
    wanted = [x.strip().upper() for x in levels if x.strip()]
    wanted = ["WARN" if x == "WARNING" else x for x in wanted]
    return records.filter(F.col("level").isin(*wanted)) if wanted else records


def bucket_shown(off: Sequence[str]) -> Column:
    return ~F.col("bucket").isin(*off) if off else F.lit(True)


def source_shown(off: Sequence[str]) -> Column:
    return ~F.col("source").isin(*off) if off else F.lit(True)


def hide_buckets(records: DataFrame, off: Sequence[str]) -> DataFrame:
    unknown = set(off) - set(fixed.BUCKETS)
    if unknown:
        raise ValueError(f"unknown buckets: {sorted(unknown)}")
    return records.filter(bucket_shown(off))


def hide_sources(records: DataFrame, off: Sequence[str] | DataFrame) -> DataFrame:
    """Drop records of switched-off sources; ``""`` is a source too. A table works as well."""
    if isinstance(off, DataFrame):
        return join_small(records, off.select("source").distinct(), ["source"], "left_anti")
    return records.filter(source_shown(off))


#: Prefixes of search words and the arguments of ``search`` they stand for.
SEARCH_KEYS = {
    "lvl": "levels", "level": "levels", "src": "srcs", "source": "srcs",
    "req": "reqs", "req_id": "reqs", "request": "reqs", "trace": "reqs", "corr": "reqs",
}


def parse_query(text: str | None) -> dict[str, list[str]]:
    """What a user typed -> the arguments of ``search``: ``key:value`` by key, all else as free words."""
    found: dict[str, list[str]] = {"levels": [], "srcs": [], "reqs": [], "words": []}
    for word in (text or "").lower().split():
        key, colon, value = word.partition(":")
        if colon and value and key in SEARCH_KEYS:
            found[SEARCH_KEYS[key]].append(value)
        else:
            found["words"].append(word)
    return found


def matches(
    levels: Sequence[str] = (),
    srcs: Sequence[str] = (),
    reqs: Sequence[str] = (),
    words: Sequence[str] = (),
) -> Column:
    """Search predicate: any level (exact), any source (substring), any id (exact), all words."""
    low = lambda items: [x.lower() for x in items]
    tests = []
    if levels:
        tests.append(F.lower("level").isin(*low(levels)))
    if srcs:
        source = F.lower("source")
        any_source = F.lit(False)
        for s in low(srcs):
            any_source = any_source | source.contains(s)
        tests.append(any_source)
    if reqs:
        tests.append((F.col("req_id") != "") & F.lower("req_id").isin(*low(reqs)))
    tests += [F.lower("line").contains(w) for w in low(words)]
    found = F.lit(True)
    for t in tests:
        found = found & t
    return found


def search(records: DataFrame, **query: Sequence[str]) -> DataFrame:
    return records.filter(matches(**query))


def pivot_req(records: DataFrame, req_id: str) -> DataFrame:
    return search(records, reqs=[req_id])


def view(
    records: DataFrame,
    off_buckets: Sequence[str] = (),
    off_sources: Sequence[str] = (),
    **query: Sequence[str],
) -> DataFrame:
    """What is shown: bucket switches, source switches and the search together."""
    return records.filter(bucket_shown(off_buckets) & source_shown(off_sources) & matches(**query))


def find(
    records: DataFrame,
    *wanted: str,
    off_buckets: Sequence[str] = (),
    off_sources: Sequence[str] = (),
    **query: Sequence[str],
) -> DataFrame:
    """``view`` over records that have no axes yet; what is found gets the ``wanted`` ones.

    A request id leaves few records, so it is looked for first, with that axis alone, and only what it
    leaves gets the others. Switches, levels and sources leave many; taking them first would
    compute what they share with the line twice, so they are tested next to the words.
    """
    reqs = query.pop("reqs", ())
    if reqs:
        records = with_axes(records, "req_id").filter(matches(reqs=reqs))
    needed = {
        "level": query.get("levels"), "bucket": off_buckets, "source": off_sources or query.get("srcs"),
        "line": query.get("words")}
    axes = dict.fromkeys([*wanted, *(a for a, used in needed.items() if used)])
    found = view(records_with(records, *axes) if axes else records, off_buckets, off_sources, **query)
    return found.drop(*[a for a in (*axes, "req_id") if a not in wanted])


def records_with(records: DataFrame, *wanted: str) -> DataFrame:
    """``with_axes`` for axes that the records don't have yet."""
    lacking = [a for a in wanted if a not in records.columns]
    held = [a for a in wanted if a in records.columns]
    if not lacking:
        return records
    # axes that are there already keep their values under other names meanwhile
    aside = records.withColumnsRenamed({a: f"_{a}_" for a in held})
    return with_axes(aside, *lacking).withColumnsRenamed({f"_{a}_": a for a in held})


def with_unexpanded(records: DataFrame) -> DataFrame:
    """Add ``unexpanded``: a string field looks like JSON but does not parse.

    A cheap native test picks the candidate values; only those reach Python.
    """
    texts = F.transform(
        F.filter(F.map_values("fields"), lambda v: v.isNotNull() & is_string(v)), lambda v: text(v)
    )
    suspects = F.filter(texts, may_be_unexpanded)
    return records.withColumn(
        "unexpanded",
        F.coalesce(any_not_json(F.when(F.size(suspects) > 0, suspects)), F.lit(False)),
    )


def unexpanded_candidates(records: DataFrame) -> DataFrame:
    """Records with at least one candidate value, so that few rows go through Python."""
    return records.filter(F.exists(
        F.map_values("fields"),
        lambda v: v.isNotNull() & is_string(v) & may_be_unexpanded(text(v)),
    ))
