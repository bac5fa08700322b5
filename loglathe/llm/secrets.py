"""Secret scans: fixed patterns, and random strings found by how badly a vocabulary compresses them."""

from __future__ import annotations

import base64
import os
import re

from pyspark import SparkFiles
from pyspark.sql import DataFrame

from loglathe.llm.base import over_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# runs are maximal, so a least length in the pattern drops the same matches as a later test would
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Letters, digits and the signs of base64 and of tokens, also several runs of them with single dots between.
CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?=[A-Za-z0-9+/_=.-]{16})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST = 16
#: Known digests (MD5, SHA-1, SHA-2 in hexadecimal) and identifiers: they look random and are public.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+)"                                      # numbers, dates, rules of dashes
)
#: Below this many characters for each token a string counts as random. English words have four and more.
MIN_RATIO = 2.0


def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in code points, by start and then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, n_tokens, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, int]]:
    """Candidates with under ``min_ratio`` characters for each token.

    Known digests and identifiers are left out, as a whole or between dots; what is left must have
    ``LEAST`` characters. Whether a name of letters is one is for the vocabulary to tell.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        rest = [part for part in m[0].split(".") if not KNOWN.fullmatch(part)]
        n = sum(map(len, rest))
        if n >= LEAST and n < min_ratio * sum(map(n_tokens, rest)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, vocabulary_path: str, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans of every whole text (null: empty).

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind in the
    order of ``KINDS``. Texts without a find have empty strings; rows are independent, so copies,
    repeated rows and any other columns make no difference, and nothing is shuffled.
    """
    spark = docs.sparkSession
    if not spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(vocabulary_path)

    def make():
        here = vocabulary_path if os.path.exists(vocabulary_path) else SparkFiles.get(os.path.basename(vocabulary_path))
        encoding = _vocabulary(here)

        def count(word):
            return len(encoding.encode_ordinary(word))

        def work(texts):
            out = [[], [], [], [], [], []]
            for text in texts:
                base = base_spans(text)
                more = random_spans(text, count, min_ratio)
                kinds = [k for _, k, _ in base]
                row = (*(kinds.count(k) for k in range(3)), len(more), joined(base), joined(sorted(base + more)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return work

    return over_texts(
        docs, make, "n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    )

