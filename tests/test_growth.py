"""Work and tables that must not grow faster than the input, on rows made here."""

from pyspark.sql import functions as F

from loglathe.operators.sizes import join_small
from loglathe.operators.multiline import assemble_multiline
from loglathe.operators.stored import Stored, grams_of, part_of
from loglathe.plans import queries, record_queries, views
from loglathe.sources.json import spread_objects


def events(spark, tmp_path, n=600):
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id",
        "element_at(array('error','view','signup','purchase','click'), int(id % 5) + 1) AS event_type", "id / 3.0D AS value",
        "concat('{\"k\": ', id % 10, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_directories_of_a_session_grow_slower_than_its_chunks(spark, tmp_path):
    s = Stored(spark, str(tmp_path / "s"), chunk_rows=4)
    s.add(spark.range(8000).selectExpr(
        "'a' AS file_id", "id AS rec_no", "'INFO' AS level", "'INFO' AS bucket", "'s' AS source", "concat('q', id) AS req_id",
        "concat('line ', id) AS line"))
    assert s._table("cells").select("chunk").distinct().count() == 2000
    assert len(list((tmp_path / "s" / "records").glob("*/*/part=*"))) < 300
    assert [r.rec_no for r in s.trace("q7001").collect()] == [7001]
    assert sorted(r.rec_no for r in s.page(6999, 9).collect()) == list(range(6999, 7008))
    assert [r.rec_no for r in s.search(words=["line 5123"]).collect()] == [5123]
    assert [r.rec_no for r in s.select("INFO", 7900).collect()] == [7900]


def test_parts_follow_chunks(spark):
    parts = [r.p for r in spark.range(5000).select(part_of(F.col("id")).alias("p")).sort("p", "id").collect()]
    assert parts[:64] == list(range(64)) and set(parts) == set(range(parts[-1] + 1)) and parts[-1] < 300
    found = spark.range(5000).select("id", part_of(F.col("id")).alias("p")).sort("id").collect()
    assert [r.p for r in found] == parts


def test_a_text_is_split_once_for_its_pieces(spark):
    df = spark.createDataFrame([("AbcD",), ("ab",), (None,)], "t string").select(grams_of(F.col("t")).alias("g"))
    assert [r.g for r in df.collect()] == [["abc", "bcd"], [], None]
    plan = plan_of(spark.range(3).select(grams_of(F.col("id").cast("string")).alias("g")))
    assert plan.count("split(") == 1  # a lambda that holds the split makes it again for each character


def test_tasks_of_records_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    assert views.spread(spark.range(0, 10_000, 1, 8)).rdd.getNumPartitions() == 100
    monkeypatch.setattr(views, "TASK_ROWS", 50_000)
    assert views.spread(spark.range(0, 10_000, 1, 20)).rdd.getNumPartitions() == 20


def test_axes_used_several_times_are_computed_once(spark, tmp_path):
    sf = events(spark, tmp_path)
    for fn in (queries.trace_many, queries.trace_anchor, queries.bookmarks, queries.hide_sources_table, queries.histogram_bin):
        df = fn(spark, sf)
        assert "from_json" not in plan_of(df) and "events.parquet" not in plan_of(df), fn.__name__
        assert df.count() > 0


def test_the_small_side_of_a_join_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    small = spark.range(50).mapInArrow(seen, "id bigint")
    assert join_small(spark.range(100).withColumn("rec_no", F.col("id")), small, ["id"], "left_semi").count() == 50
    assert made.value == 50


def test_the_overview_computes_levels_once(spark, tmp_path):
    plan = plan_of(record_queries.overview(spark, events(spark, tmp_path)))
    assert plan.count("from_json") <= 2


def test_lines_are_classed_and_pieces_matched_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    texts = ["x ERROR y", "Traceback (most recent call last):", '  File "a.py", line 1, in f', "ValueError: no", "plain"] * 20
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_id string, line_no bigint, raw_line string")
    assert assemble_multiline(lines.mapInArrow(seen, lines.schema)).count() == 40
    assert made.value == len(texts)
    spread = ["{", ' "a": 1', "}"] * 20
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(spread)], "file_id string, line_no bigint, raw_line string")
    made.value = 0
    assert spread_objects(lines.mapInArrow(seen, lines.schema)).count() == 20
    assert made.value == len(spread)
