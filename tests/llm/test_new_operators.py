"""Prefix trie, hard negatives and exact dedup against plain loops, and over odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import exact_dedup, hard_negatives, prefix_trie
from tests.llm.texts import frame, messy, sample

CONV = "conv_id long, turn long, role string, text string"


def conversations(seed=4, n=330):
    """Conversations that share beginnings: many start alike, some are equal, one is long, ids have gaps."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 13 == 7:
            continue
        k, r = rng.randrange(0, 9), random.Random(c % 9)
        for t in range(k):
            alike = c % 3 == 0 or rng.random() < 0.6
            text = f"same {t}" if alike and t < 6 else f"é{r.randrange(4)}" if t % 2 else None
            rows.append((c, t if t else None, ("user", "assistant", None)[t % 3], text))
    rows += [(n + 5, t, "user", f"long {t}") for t in range(300)]
    rows += [(n + 9, 1, "user", "twice"), (n + 9, 1, "user", "twice"), (n + 9, 1, "a", "tie"), (-100, 0, "user", "minus"), (-7, 0, "x", "y")]
    rng.shuffle(rows)
    return rows


def slow_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:3], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))]
           for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
        ends[s].append(c)
    out = {}

    def total(node):
        leaves, saved = (0, 0) if children[node] else (1, 0)
        saved += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for x in children[node]:
            a, b = total(x)
            leaves, saved = leaves + a, saved + b
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(children[node]), leaves, saved, sha)
        return leaves, saved

    if built:
        total(())
    return out


@pytest.mark.parametrize("container", [10**6, 40, 1])
def test_trie(spark, container):
    rows = conversations()
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, CONV)), container).collect()
    want = slow_trie(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): (
        r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (2, 5, "", ""), (2, 5, "u", "a" * 300_000)]
    for some in ([], rows):
        df = spark.createDataFrame(some, CONV).withColumns({c: F.lit(1) for c in ("key", "ids", "n", "seq", "h", "first")})
        got = prefix_trie.trie(prefix_trie.rebuilt(df)).collect()
        assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == slow_trie(some)


def test_ends_of_many_members(spark):
    """Ids of one end cross many pieces."""
    ids = [*range(-700, 900, 3), 10**12]
    df = spark.createDataFrame([(c,) for c in ids], "conv_id long").withColumn("turns", F.array(F.struct(
        F.lit(b"t").alias("id"), F.lit(2).cast("long").alias("cp"))))
    top, end = sorted(prefix_trie.trie(df).collect(), key=lambda r: r.depth)
    assert end.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (top.n_convs, top.saved_tokens, top.n_leaves) == (len(ids), 2 * (len(ids) - 1), 1)


EMB = "vec_id long, embedding array<float>, label int"


def vectors(seed=2, n=700, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        k = 0 if i % 3 == 0 else int(rng.integers(4))
        v = centres[k] * rng.uniform(0.3, 1) + rng.normal(size=d) * 0.4 + (0.5 if i % 5 else -0.5)
        rows.append((i, [float(np.float32(x)) for x in v], (k + int(rng.random() < 0.3)) % 4))
    for i in range(0, n, 9):                                   # ties
        rows[i] = (rows[i][0], rows[(i + 45) % n][1], rows[i][2])
    return rows


def slow_negatives(rows, step):
    rows = {i: ([math.floor(256 * x) for x in v], k) for i, v, k in rows}
    out = {}
    for a in (i for i in rows if i % step == 0):
        scored = sorted((-sum(x * y for x, y in zip(rows[a][0], v)), i, k) for i, (v, k) in rows.items() if i != a)
        for ps, p, _ in [x for x in scored if x[2] == rows[a][1]][:5]:
            fits = [(s, i) for s, i, k in scored if k != rows[a][1] and 30 * -ps <= 100 * -s <= 90 * -ps]
            for rank, (s, i) in enumerate(fits[:10], 1):
                out[a, p, rank] = (i, -ps, -s)
    return out


@pytest.mark.parametrize("part", [10**6, 60])
def test_hard_negatives(spark, monkeypatch, part):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_PART", part)
    rows = vectors()
    got = hard_negatives.mine(spark.createDataFrame(rows, EMB), F.col("vec_id") % 20 == 0).collect()
    want = slow_negatives(rows, 20)
    assert {(r.anchor_id, r.positive_id, r.rank): (r.negative_id, r.positive_score, r.negative_score) for r in got} == want
    assert len(got) == len(want) > 500


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(1)
    a, b = (hard_negatives.Summaries((rng.normal(size=(n, 30)) * 90 + 40).astype(np.int64)) for n in (7, 200))
    exact = a.exact @ b.exact.T
    width = []
    for level in range(len(a.levels)):
        least, most = hard_negatives._bounds(a, b, level)
        assert (least <= exact).all() and (exact <= most).all()
        i, j = (x.ravel() for x in np.indices(exact.shape))
        listed = hard_negatives._bounds(a, b, level, (i, j))
        assert np.allclose(listed[0], least[i, j]) and np.allclose(listed[1], most[i, j])
        width.append((most - least).mean())
    assert width == sorted(width, reverse=True) and width[-1] < width[0]


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [0.5, 1.0], 1), (1, [1.0, None], 1), (2, None, 1), (3, [1.0, float("nan")], 2), (4, [float("inf")], 2),
            (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [], 1), (7, [1.0], 1), (8, [0.5, 0.2, 9.0], 2), (9, [1e30, 1.0], 3),
            (9, [1e30, 1.0], 3), (10, [0.6, 0.0], 2)]
    df = spark.createDataFrame(rows, EMB).withColumns({c: F.lit(1) for c in ("part", "kind", "id", "v", "slot", "score", "rank", "asks")})
    got = hard_negatives.mine(df, F.col("vec_id") == 0).collect()
    assert {(r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got} == {
        (7, 1, 8, 32768, 128 * 128 + 256 * 51), (7, 2, 10, 32768, 128 * 153)}
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert hard_negatives.mine(df.where("label = 1"), F.col("vec_id") == 0).collect() == []


def slow_copies(rows):
    def plain(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)})

    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[plain(text)].append(doc_id)
    return [(d, max((x for x in groups[plain(t)] if x is not None), default=None), len(groups[plain(t)]),
             hashlib.sha256(plain(t).encode()).hexdigest()) for d, t, *_ in rows]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("hot", [1000, 3])
def test_exact_dedup(spark, monkeypatch, weak, hot):
    """A weak hash puts many texts under one value; results stay the same."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
    rows = [*messy(), *((100 + i, t if i % 2 else t.upper(), *x) for i, t, *x in sample(n=60)), *((900 + i, "HOT copy É", "en", "s", 9) for i in range(50))]
    used = (lambda t: F.substring(F.unhex(F.md5(t.cast("binary"))), 1, 1)) if weak else exact_dedup.hash128
    got = exact_dedup.classes(frame(spark, rows, clashing=True), used).collect()
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, slow_copies(rows)))
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in x) == 1 and all(r.doc_id == r.keep_id for r in x if r.kept) for x in by.values())
    docs = frame(spark, rows, clashing=True)
    kept = exact_dedup.drop_copies(docs, used)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(x[0].keep_id for x in by.values())


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.classes(frame(spark, [])).collect() == []
    assert exact_dedup.drop_copies(frame(spark, [])).collect() == []
