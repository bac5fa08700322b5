"""A stored session answers as its records do, from a part of them."""

import pytest
from pyspark.sql import functions as F

from loglathe.operators import counts, search
from loglathe.operators.stored import Stored


def logs(spark, n=6000):
    """Three files; one request and one word occur in few places, another request everywhere."""
    return spark.range(n).selectExpr(
        "concat('00', id % 3) AS file_id", "id div 3 AS rec_no", "element_at(array('ERROR','WARN','INFO'), int(id % 7 % 3) + 1) AS level",
        "element_at(array('ERROR','WARN','INFO'), int(id % 7 % 3) + 1) AS bucket", "concat('s', id % 4) AS source",
        "CASE WHEN id IN (1500, 1503, 4001) THEN 'rare' WHEN id % 5 = 0 THEN '' ELSE concat('q', id % 11) END AS req_id",
        "concat('Ünit ', id, CASE WHEN id BETWEEN 3000 AND 3020 THEN ' Zyzzyva' ELSE ' plain' END) AS line",
    )


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = Stored(spark, str(tmp_path_factory.mktemp("stored") / "s"), chunk_rows=100)
    s.add(logs(spark).where("file_id <> '002'"))
    s.add(logs(spark).where("file_id = '002'"))
    return s


def read_of(df):
    """(rows, bytes of record files read): what the scan of the records opened when ``df`` ran."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    sizes = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet") and "/records" in node.toString():
            sizes.append(node.metrics().apply("filesSize").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return rows, sum(sizes)


def key(rows):
    return sorted((r.file_id, r.rec_no) for r in rows)


def whole(session):
    return read_of(session.records)[1]


def test_one_request_reads_a_part(spark, session):
    rows, size = read_of(session.trace("rare"))
    assert key(rows) == key(logs(spark).where("req_id = 'rare'").collect()) and len(rows) == 3
    assert 0 < size < whole(session) / 10
    rows, size = read_of(session.trace("q1"))
    assert key(rows) == key(logs(spark).where("req_id = 'q1'").collect())
    assert session.trace("").count() == session.trace("nowhere").count() == 0


def test_words_skip_chunks(spark, session):
    every = session._table("cells").select("load", "file_id", "chunk").distinct().count()
    for words, most in ((["zyzzyva"], 4), (["ünit 30", "ZYZZ"], 4), (["zy"], every), (["nothing"], 0), ([], every)):
        rows, _ = read_of(session.search(words=words, off_sources=["s1"]))
        assert key(rows) == key(search.view(logs(spark), off_sources=["s1"], words=words).collect())
        assert session.places_with(words).count() <= most
    assert every == 60 and read_of(session.search(words=["zyzzyva"]))[1] < whole(session) / 10


def test_counts_follow_added_and_dropped_files(spark, tmp_path):
    s = Stored(spark, str(tmp_path / "s"), chunk_rows=100)
    s.add(logs(spark).where("file_id = '000'"))
    s.add(logs(spark).where("file_id <> '000'"))
    s.drop("001")
    left = logs(spark).where("file_id <> '001'")
    flat = lambda df: sorted(map(tuple, df.collect()))
    assert flat(s.facets(["INFO"], ["s2"])) == flat(counts.facets(left, ["INFO"], ["s2"]))
    assert flat(s.source_counts()) == flat(counts.source_counts(left))
    assert flat(s.metrics()) == flat(counts.level_counts(left))
    assert flat(s.histogram("WARN")) == flat(counts.level_histogram(left, "WARN"))
    assert flat(s.trace_summary()) == flat(left.where("req_id <> ''").groupBy("req_id").agg(F.count("*"), F.countDistinct("file_id")))
    assert s.distinct_requests().first().n == left.where("req_id <> ''").select("req_id").distinct().count()
    assert s.records.count() == left.count() and "/records" not in s.facets()._jdf.queryExecution().executedPlan().toString()
    s.add(logs(spark).where("file_id = '001'").where("rec_no < 50"))           # the file comes back, shorter
    assert {r.file_id: r.filtered for r in s.metrics().collect()} == {"000": 2000, "001": 50, "002": 2000}


def test_positions_read_only_edges(spark, session):
    flat = lambda df: sorted(map(tuple, df.collect()))
    for bins in (20, 7, 3):
        assert flat(session.histogram("ERROR", bins)) == flat(counts.level_histogram(logs(spark), "ERROR", bins))
        assert session.edges(bins).count() <= 3 * (bins - 1)
    rows, size = read_of(session.page(250, 120))
    assert key(rows) == [(f, n) for f in ("000", "001", "002") for n in range(250, 370)] and size < whole(session) / 5
    for rank in (0, 99, 512):
        got = key(session.select("WARN", rank).collect())
        want = [(f, sorted(r.rec_no for r in logs(spark).where(f"file_id = '{f}' AND bucket = 'WARN'").collect())[rank])
                for f in ("000", "001", "002")]
        assert got == want
    assert session.select("WARN", 10**6).count() == 0


def test_an_empty_session(spark, tmp_path):
    s = Stored(spark, str(tmp_path / "s"))
    assert s.source_counts().count() == 0 and s.metrics().count() == 0 and s.distinct_requests().first().n == 0
