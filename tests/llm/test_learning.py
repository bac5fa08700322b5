"""Held-out accuracy of the classifiers, and the pipeline as a whole."""

import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from loglathe.llm import decontaminate, line_dedup, quality, queries, simhash, toxicity
from loglathe.llm.linear import BITS, Sample, held_out
from tests.llm.texts import words

SF = "/root/testdata/sf0.01"


def corpus(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(1200):
        toxic, poor = i % 8 == 0, i % 5 == 1
        text = words(rng, rng.randrange(20, 200), 900).split()
        for _ in range(2 + len(text) // 60 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["vile", "rotten", "Scum!", "filth."])
        docs.append((i, " ".join(f"{w.upper()}!!" for w in text) if poor else " ".join(text)))
        labels.append((i, int(toxic), 0 if poor else 1 if toxic else 2))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, grade int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(held_out()).collect()
    right = [(r.score >= 0.5) == bool(r.toxic) for r in rows]
    assert len(rows) > 200 and np.mean(right) > 0.95
    again = toxicity.train(docs.repartition(7), labels)
    assert again.bias == model.bias and (again.weights == model.weights).all()
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    ids = {r.doc_id for r in labels.where(held_out()).collect()}
    assert ids == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels.select("doc_id", "grade"))
    assert (np.diff(model.cuts) > 0).all()
    rows = quality.grade(docs, model).join(labels, "doc_id").where(held_out()).collect()
    assert np.mean([(r.tail_probability >= 0.5) == (r.grade >= 1) for r in rows]) > 0.95
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_nnpu_stays_above_zero_risk():
    """More capacity than data: the corrected risk keeps the unlabelled positives from being pushed down."""
    from loglathe.llm.linear import word_ids

    rng = random.Random(2)
    pos = [word_ids(words(rng, 30) + " vile rot") for _ in range(120)]
    mix = [word_ids(words(rng, 30) + (" vile rot" if i % 4 == 0 else "")) for i in range(400)]
    model = toxicity.fit_placed(pos, mix, 0.25)
    fresh = [words(rng, 30) + (" vile rot" if i % 4 == 0 else "") for i in range(400)]
    said = np.array(model.scores(fresh)) >= 0.5
    assert np.mean(said == (np.arange(400) % 4 == 0)) > 0.95


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    tables = [docs]
    for name, stage in p.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    clean, lined, single, safe, mixed = tables[1:]
    assert all(t.columns == docs.columns for t in tables[:-1]) and mixed.columns == [*docs.columns, "copy"]
    scores = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert clean.count() == scores.where("score < 0.5").count() < docs.count()
    assert lined.count() == clean.count()
    assert line_dedup.line_report(lined).agg(F.sum("n_removed")).first()[0] == 0
    groups = simhash.classes(lined)
    assert {r.doc_id for r in single.collect()} == {r[0] for r in groups.select("component_id").distinct().collect()}
    leaks = decontaminate.contained(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert safe.count() == single.count() - leaks.select("doc_id").distinct().count()
    whole = queries.mixing.mix(safe).where("taken > 0")
    assert mixed.count() == whole.select(F.sum(F.col("taken") / F.col("size"))).first()[0]
    assert sorted(map(repr, p.run(spark, SF).collect())) == sorted(map(repr, mixed.collect()))


def test_sample_takes_little_of_the_driver():
    """12 bytes for each entry that stays, and no array of all entries for a product; sums are those of one pass."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(1500):
        ids = np.unique(rng.integers(0, 40_000, 400).astype(np.int32))
        rows.append((ids, rng.random(len(ids)).astype(np.float32)))
    weights, slope = rng.normal(size=1 << BITS), rng.normal(size=1500)
    tracemalloc.start()
    x = Sample(rows, 4)
    n = len(x.id)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    down, back = x.dot(weights), x.back(slope)
    product = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert n > 400_000 and held < 13 * n and peak < 12 * n + (6 << 20) and product < 8 << 20
    row = np.repeat(np.arange(1500), [len(i) for i, _ in rows])
    ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    stays = np.bincount(ids, minlength=1 << BITS)[ids] >= 4
    row, ids, values = row[stays], ids[stays], values[stays]
    assert n == len(ids) and (down == np.bincount(row, values * weights[ids], minlength=1500)).all()
    assert (back == np.bincount(ids, values * slope[row], minlength=1 << BITS)).all()
    assert not Sample([], 4).dot(weights).any() and not Sample([], 4).back(np.zeros(0)).any()
