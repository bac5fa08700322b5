"""What line dedup puts into plans and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglathe.llm import line_dedup


def test_plan_does_not_hold_the_table_of_rarity(spark):
    """The driver holds plans and their descriptions: classes of rarity are a value of the job, one for all lines."""
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, None), (3, "a b f")], "doc_id long, text string")
    made = line_dedup.prepared(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000
    assert "array_repeat(scalar-subquery" in plan     # in the projection that orders words: no row carries the table
    assert sorted(r.n for r in made.collect()) == [0, 2, 3, 3]


def test_bitmap_passes_all_lines_that_are_met(spark):
    """Lines that may be met pass before the shuffle of texts, others by chance only; negative hashes and no lines at all too."""
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("l1"))
    met = hashes.where("l1 % 10 = 0")
    n = met.count()
    passed = hashes.where(line_dedup.maybe_in(met, line_dedup._bits_for(n)))
    assert passed.join(met, "l1", "left_semi").count() == n and 0 < n <= passed.count() < 2 * n + 2_000
    assert met.where("l1 < 0").count() > 0
    assert hashes.where(line_dedup.maybe_in(met.where("false"), line_dedup._bits_for(0))).count() == 0
    assert line_dedup._bits_for(10**12) == 1 << 26


def test_texts_of_lines_without_a_candidate_are_not_shuffled(spark, tmp_path):
    """Only lines of candidate pairs are fetched, whatever else there is."""
    rows = [(i, f"{'same words here and some more of them now ok ' if i < 20 else ''}x{i} " + " ".join(f"u{i}q{j}" for j in range(0 if i < 20 else 12))) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.line_report(docs).where("n_removed > 0").collect()}
    assert got == set(range(1, 20))


def test_few_tables_for_lines_with_several_candidates(spark, monkeypatch):
    """Each table costs the driver a plan and tasks: 30 candidates, the last of which alone matches, take two rounds."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5))) for i in range(30)] + [(30, " ".join(f"w29x{j}" for j in range(5)) + " ")]
    lines = spark.createDataFrame(rows, "doc_id long, line string").withColumn("l1", F.col("doc_id")).withColumn("l2", -F.col("doc_id"))
    nodes = lines.select("l1", "l2", F.struct(F.lit(False).alias("no"), "doc_id").alias("first"), F.lit(5).alias("n"), F.lit(None).cast("array<long>").alias("wide"))
    pairs = spark.createDataFrame([(30, i) for i in range(30)] + [(1, 0)], "late long, early long")
    kept, keep = [], line_dedup.keep
    monkeypatch.setattr(line_dedup, "keep", lambda df, name: kept.append(name) or keep(df, name))
    assert [tuple(r) for r in line_dedup.with_earlier_match(lines, nodes, pairs).collect()] == [(30, -30)]
    assert kept.count("line-repeats") == 2 and kept.count("line-todo") == 2
    kept.clear()
    assert line_dedup.with_earlier_match(lines, nodes, pairs.where("false")).collect() == []
    assert kept.count("line-repeats") == 1 and kept.count("line-todo") == 1
