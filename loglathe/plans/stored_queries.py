"""Queries over a stored session: the same answers as over the records, from a part of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loglathe.operators import trace
from loglathe.operators.materialize import shared_folder
from loglathe.operators.stored import Stored
from loglathe.plans import ducksql as d
from loglathe.plans.catalog import query
from loglathe.plans.queries import SEARCH_SQL, all_axes

A = d.ALL_AXES


def stored(spark, sf, *later: str) -> Stored:
    """The whole log, stored: the files named come in a second load."""
    records = all_axes(spark, sf, "level", "bucket", "source", "req_id", "line").drop("fields")
    session = Stored(spark, f"{shared_folder(spark)}/loglathe/session-{uuid.uuid4().hex}", chunk_rows=256)
    first = F.col("file_id").isin(*later) if later else F.lit(False)
    session.add(records.filter(~first))
    if later:
        session.add(records.filter(first))
    return session


@query("stored_trace", d.select(A, "SELECT file_id, rec_no, line FROM axes WHERE req_id = 'r8'"))
def stored_trace(spark, sf):
    return trace.in_order(stored(spark, sf).trace("r8")).select("file_id", "rec_no", "line")


@query("stored_search", d.select(A, f"SELECT file_id, rec_no, line FROM axes WHERE {SEARCH_SQL}"))
def stored_search(spark, sf):
    return stored(spark, sf).search(levels=["error", "warn"], srcs=["API", "work"], words=["r1", "Error"]).select("file_id", "rec_no", "line")


@query("stored_facets", d.select(A, """, held AS (SELECT * FROM axes WHERE file_id <> 'f1')
SELECT 'bucket' AS facet, b.bucket AS name, count(f.bucket) AS n
FROM (VALUES ('ERROR'), ('WARN'), ('INFO'), ('DEBUG'), ('OTHER')) AS b(bucket)
LEFT JOIN (SELECT * FROM held WHERE source NOT IN ('cache')) f ON f.bucket = b.bucket GROUP BY b.bucket
UNION ALL
SELECT 'source', s.source, count(f.source) FROM (SELECT DISTINCT source FROM held) s
LEFT JOIN (SELECT * FROM held WHERE bucket NOT IN ('INFO', 'ERROR')) f ON f.source = s.source GROUP BY s.source"""))
def stored_facets(spark, sf):
    """One file comes later and one goes; the counts follow without the other files' records."""
    session = stored(spark, sf, "j2")
    session.drop("f1")
    return session.facets(off_buckets=["INFO", "ERROR"], off_sources=["cache"])


@query("stored_histogram", d.select(A, """, totals AS (SELECT file_id, count(*) AS total FROM axes GROUP BY file_id),
placed AS (SELECT file_id, CAST(least(19, floor(CAST(rec_no AS DOUBLE) / CAST(total AS DOUBLE) * 20)) AS INT) AS bin
  FROM axes JOIN totals USING (file_id) WHERE bucket = 'ERROR')
SELECT t.file_id, CAST(b.bin AS INT) AS bin, count(p.bin) AS n
FROM totals t CROSS JOIN range(20) AS b(bin) LEFT JOIN placed p ON p.file_id = t.file_id AND p.bin = b.bin
GROUP BY t.file_id, b.bin"""))
def stored_histogram(spark, sf):
    return stored(spark, sf).histogram("ERROR")
