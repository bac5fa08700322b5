"""Every operator and stage over nulls, odd texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import public_tokenizers
import pytest

from loglathe.llm import (
    decontaminate, line_dedup, mixing, order_minhash, quality, secrets, simhash, suffix_array, token_counts, toxicity,
)
from loglathe.llm.base import fresh_path
from loglathe.llm.linear import BITS, word_and_shape_ids, word_ids
from tests.llm.texts import frame, messy, sample

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TOXIC = toxicity.ToxicModel(np.zeros(1 << BITS), -1.0, 0.1)
TOXIC.weights[word_ids("another öäü")[0]] = 5.0
GRADES = quality.fit_ordinal([word_and_shape_ids("vile!!!"), word_and_shape_ids("good day")] * 8, [0, 2] * 8, steps=30)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "w1x w2x w3x w4x w5x w6x"), (1, "w1x w2x w3x w4x w5x w6x"), (2, None), (None, "a b c d e f"), (3, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "suffix": lambda d, items: suffix_array.removals(d),
    "kept": lambda d, items: suffix_array.without_repeats(d),
    "toxic": lambda d, items: toxicity.score(d, TOXIC),
    "grade": lambda d, items: quality.grade(d, GRADES),
    "omh": lambda d, items: order_minhash.against_next(d),
    "print": lambda d, items: order_minhash.fingerprints(d),
    "lines": lambda d, items: line_dedup.line_report(d),
    "mix": lambda d, items: mixing.mix(d),
    "tokens": lambda d, items: token_counts.count_tokens(d, JSON, fresh_path(d.sparkSession, "test-cache")),
    "simhash": lambda d, items: simhash.classes(d),
    "secrets": lambda d, items: secrets.scan_secrets(d, RANKS),
}
FILTERS = {
    "toxic": lambda d, items: toxicity.drop_toxic(d, TOXIC),
    "quality": lambda d, items: quality.select(d, GRADES),
    "lines": lambda d, items: line_dedup.drop_repeated_lines(d),
    "simhash": lambda d, items: simhash.drop_near(d),
    "leaks": lambda d, items: decontaminate.drop_contaminated(d, items),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, items, name):
    rows = messy()
    plain = PER_ROW[name](frame(spark, rows), items).collect()
    assert sorted(r.doc_id for r in plain if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    assert len(plain) == len(rows)
    clashing = PER_ROW[name](frame(spark, rows, clashing=True), items).collect()
    assert sorted(map(repr, clashing)) == sorted(map(repr, plain))


@pytest.mark.parametrize("name", [*PER_ROW, "contained"])
def test_empty_tables(spark, items, name):
    call = PER_ROW.get(name, lambda d, items: decontaminate.contained(d, items))
    assert call(frame(spark, []), items).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(spark, items, name):
    docs = frame(spark, messy(), clashing=True)
    out = FILTERS[name](docs, items)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert 0 < out.count() <= docs.count()
    assert FILTERS[name](frame(spark, []), items).collect() == []


def test_mix_of_clashing_columns(spark):
    docs = frame(spark, messy(), clashing=True)
    assert mixing.mixed(docs).columns == [*docs.columns, "_copy"]
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, sample())).columns[-1] == "copy"


def test_training_without_labels(spark):
    docs, none = frame(spark, sample()), spark.createDataFrame([], "doc_id long, toxic int, grade int")
    assert toxicity.score(docs, toxicity.train(docs, none)).where("score between 0 and 1").count() == docs.count()
    assert quality.grade(docs, quality.train(docs, none)).count() == docs.count()
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 2), (4, 0, 0)], none.schema)
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == docs.count()
    assert quality.grade(docs, quality.train(docs, odd)).count() == docs.count()
