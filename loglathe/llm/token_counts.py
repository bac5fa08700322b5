"""Token counts with a digest cache: only contents never counted before are encoded."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import column_batches, keep

CACHE = "version string, digest binary, n_tokens long"
#: A byte-level tokenizer ends a piece at each of these places, whatever stands before and after them: before a blank or
#: line break behind a visible ASCII sign, and between an ASCII letter and a full stop or comma.
CUTS = re.compile(r"(?<=[!-~])(?=[ \n])|(?<=[A-Za-z])(?=[.,])")
#: A task remembers counts of so many pieces, none of more characters than ``LONGEST``.
REMEMBERED, LONGEST = 1 << 18, 48


def version_of(tokenizer_path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary never meets this one's counts."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(tokenizer_path: str):
    """Texts to token numbers by the library of the file: ``tokenizers`` for .json, ``sentencepiece`` for .model."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        return lambda texts: [[len(x) for x in model.encode(texts, num_threads=1)] if texts else []]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    return (lambda texts: [by_pieces(texts)]) if (by_pieces := _by_pieces(model, whole)) else lambda texts: [whole(texts)]


def _by_pieces(model, whole):
    """Counts of texts as sums over what ``CUTS`` leaves, each different piece encoded once; None for other layouts.

    Nothing may look across a cut, so it is for byte-level BPE with its usual pattern and without a
    normaliser or dropout. Texts with a special string in them are encoded whole.
    """
    from tokenizers import models, pre_tokenizers

    split, bpe = model.pre_tokenizer, model.model
    if model.normalizer or not isinstance(split, pre_tokenizers.ByteLevel) or not isinstance(bpe, models.BPE) \
            or split.add_prefix_space or not split.use_regex or bpe.dropout:
        return None
    special = [x.content for x in model.get_added_tokens_decoder().values()]
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        pieces = [[x] if any(s in x for s in special) else CUTS.split(x) for x in texts]
        new = list(set().union(*pieces) - known.keys())
        known.update(zip(new, whole(new), strict=True))
        found = [sum(map(known.__getitem__, p)) for p in pieces]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        if len(known) > REMEMBERED:
            known.clear()
        return found

    return counts


def _local(tokenizer_path: str) -> str:
    """The file itself where this machine has it, else the copy that Spark sent along."""
    return tokenizer_path if os.path.exists(tokenizer_path) else SparkFiles.get(os.path.basename(tokenizer_path))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, digest of every row of ``docs``, whole texts (null: empty).

    The cache at ``cache_path`` (a folder all executors share; made where missing) holds one row
    for each (tokenizer version, SHA-256 of the content). Content is normalised only by taking
    null as empty: anything more could change a count. Contents that the cache lacks are encoded
    once each and appended, then every row looks its count up. Empty tables give no rows, copies
    share one encoding, rows repeated whole each come back, other columns are ignored.
    An append that is run again after a failure repeats cache rows; reading takes one of each.
    """
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    if not spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    body = F.coalesce("text", F.lit(""))
    digested = docs.select("doc_id", body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = (
        digested.join(known().select("digest"), "digest", "left_anti")
        .groupBy("digest").agg(F.first("text").alias("text"))
    )
    counted = column_batches(misses, ["text"], lambda: encoder(_local(tokenizer_path)), "n_tokens long", ["digest"])
    # counted once: the table is what both the cache and nothing else reads
    keep(counted, "token-misses").select(F.lit(version).alias("version"), "digest", "n_tokens") \
        .write.mode("append").parquet(cache_path)
    slim = digested.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return slim.join(known(), "digest").select("doc_id", "n_bytes", "n_tokens", F.lower(F.hex("digest")).alias("digest"))
