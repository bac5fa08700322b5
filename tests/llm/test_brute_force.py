"""Operators against plain loops over small documents."""

import collections
import hashlib
import itertools
import random
import re
import string
import zlib

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglathe.llm import (
    components, decontaminate, line_dedup, mixing, order_minhash, secrets, simhash, suffix_array, token_counts,
)
from loglathe.llm.base import fresh_path
from tests.llm.texts import frame, sample

ROWS = sample(n=80)


def repeats(rows, length=200):
    seen = collections.Counter()
    for _, text in rows:
        data = text.encode()
        seen.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = {}
    for doc_id, text in rows:
        data = text.encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not before for g, before in zip(gone, [False, *gone]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("suffixes", [50_000, 7])
def test_suffix_array(spark, monkeypatch, suffixes):
    monkeypatch.setattr(suffix_array, "SUFFIXES", suffixes)      # many boundaries to compare across
    got = suffix_array.removals(frame(spark, ROWS)).collect()
    want = repeats([r[:2] for r in ROWS])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_multikey_sort(rows):
    order, lcp = suffix_array.multikey_sort(rows, 40)
    padded = [rows[i].ljust(40, b"\0") for i in order]
    assert padded == sorted(padded)
    for i in range(1, len(rows)):
        a, b = padded[i - 1], padded[i]
        assert lcp[i] == next((k for k in range(40) if a[k] != b[k]), 40)


def test_anchors_cover_every_start():
    data = sample(9)[4][1].encode() * 3
    place, first, last, lead = suffix_array.anchors(data)
    starts = [p for a, b in zip(first, last) for p in range(a, b + 1)]
    assert starts == list(range(len(data) - 199))
    assert all(p <= a <= p + 136 for a, f, l in zip(place, first, last) for p in (f, l))


def line_removals(rows, t=0.8, least=1):
    places = []
    for doc_id, text in rows:
        for i, line in enumerate(text.split("\n")):
            own = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if len(own) >= least:
                places.append((doc_id, i, own))
    gone = collections.defaultdict(list)
    for at, (doc_id, i, own) in enumerate(places):
        if any(len(own & o) >= t * len(own | o) - 1e-9 for _, _, o in places[:at]):
            gone[doc_id].append(i)
    return gone


def test_line_dedup(spark):
    short = ["aa bb cc dd", "aa bb cc dd ee", "dd cc bb aa", "zz", "ZZ", "aa bb cc", "", "cc bb  aa\taa", "aa bb", "yy"]
    docs = [*ROWS, (700, "\n".join(short), "en", "s", 0), (701, "\n".join(short[::-1]) + "\nnew line", "en", "s", 0)]
    rows = [r[:2] for r in docs]
    want = line_removals(rows)
    got = line_dedup.line_report(frame(spark, docs)).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == {d: ",".join(map(str, x)) for d, x in want.items()}
    assert want[700] == [1, 2, 4, 7] and want[701] == list(range(10))[:3] + list(range(4, 10))
    kept = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, docs)).collect()}
    for doc_id, text in rows:
        lines = [x for i, x in enumerate(text.split("\n")) if i not in want.get(doc_id, ())]
        assert kept[doc_id].text == "\n".join(lines) and kept[doc_id].n_chars == len("\n".join(lines))


def test_groups_of_near_copies(spark):
    """Lines of a group are found though their rarest words are their own; the first one meets none of them."""
    rng = random.Random(11)
    base = [f"g{i}x" for i in range(30)]
    lines = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(30)] = f"e{rng.randrange(40)}y"
        lines.append(" ".join(own))
    docs = [(i // 3 if i % 7 else None, "\n".join(lines[i:i + 2]), "en", "s", 0) for i in range(0, 150, 2)]
    rows = sorted(((d, x) for d, x, *_ in docs), key=lambda r: (r[0] is None, r[0] or 0))
    same_id = collections.Counter(r[0] for r in rows)
    rows = [r for r in rows if same_id[r[0]] == 1]              # places of one id's texts are in the order of hashes
    want = line_removals(rows)
    got = line_dedup.line_report(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == {d: ",".join(map(str, x)) for d, x in want.items()} and want


def slow_simhash(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    rows = [*(r[:2] for r in ROWS), (500, ""), (501, "One"), (502, "one"), (503, "É two three four")]
    got = simhash.classes(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()
    prints = {d: slow_simhash(x) for d, x in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in prints}
    kept = {r.doc_id for r in simhash.drop_near(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()}
    assert kept == {d for d in prints if find(d) == d}


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_links_within_bits(spark, bits):
    values = sorted({(x * 0x9E3779B97F4A7C15 ^ f) % 2**64 for x in range(9)
                     for f in (0, 1, 3, 7, 15, 1 << 40, 1 << 40 | 1, 3 << 60, 3 << 60 | 6, 1 << 33 | 1 << 5)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()
    want = sorted((min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
                  if ((a ^ b) % 2**64).bit_count() <= bits)
    assert sorted((r.a, r.b) for r in got) == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert len(got) == 44


def item_shingles(text, width):
    words = decontaminate.words_of(text or "")
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_contained(spark):
    items = [(i, " ".join(text.split()[2:2 + 8 + i])) for i, (_, text, *_) in enumerate(ROWS[:12])]
    items += [(99, "nothing of this stands in any of these documents"), (20, "Alpha beta\tgamma"), (21, "beta"), (22, "delta alpha"),
              (23, None), (24, " "), (25, "alpha beta gamma"), (25, "gamma delta")]
    docs = [*ROWS, (800, "long one: alpha  beta gamma delta, and more words", "en", "s", 0), (801, "Beta", "en", "s", 0),
            (802, "alpha betagamma", "en", "s", 0), (803, None, "en", "s", 0), (804, "alpha beta gamma delta", "en", "s", 0)]
    got = decontaminate.contained(
        frame(spark, docs), spark.createDataFrame([*items, (None, "beta")], "item_id long, text string"), size=4).collect()
    want = []
    for item_id, text in items:
        width = min(5, len(decontaminate.words_of(text or "")))
        own = item_shingles(text, width) if width else set()
        for doc_id, body, *_ in docs:
            shared = len(own & item_shingles(body, width))
            if own and shared >= 0.8 * len(own):
                want.append((doc_id, item_id, shared, len(own)))
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got) == sorted(want)
    assert {(800, 20), (800, 21), (801, 21), (800, 25), (804, 25)} <= {w[:2] for w in want} and (802, 21) not in {w[:2] for w in want}
    kept = decontaminate.drop_contaminated(
        frame(spark, docs, True), spark.createDataFrame(items, "item_id long, text string"), size=4).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, *_ in docs} - {w[0] for w in want})


def test_blocks_by_characters(spark):
    items = spark.createDataFrame([(i, f"word{i} " * 10) for i in range(40)], "item_id long, text string")
    parts = list(decontaminate.blocks(items, chars=1000))
    assert len(parts) > 2 and sum(len(x.items) for x in parts) == 40
    assert [x.items for x in decontaminate.blocks(items.limit(0))] == [[]]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.data())
def test_sketch_never_misses(n, data):
    """Whatever a containing document lacks, one of the sketch's minima is left."""
    words = [f"u{i}" for i in range(n + 4)]
    index = decontaminate.Index([(1, " ".join(words))])
    own = decontaminate.shingles(" ".join(words))
    lacking = set(data.draw(st.permutations(own))[:n - -(-8 * n // 10)])
    minima = index.tables[5][decontaminate.size_class(len(own))]
    assert any(s not in lacking for s in minima)
    left = [s for s in own if s not in lacking]
    if len(left) >= 5:                                          # a class too large for the document is never the item's
        assert len(left) >= 0.8 * 2 ** decontaminate.size_class(len(own)) - 1e-9


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), "en", None if i % 50 == 0 else f"s{min(i % 9, 5)}", 0) for i in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 3 * size[s] for s in full})
        open_ -= full
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in names)
    assert sorted(got) == sorted(mixing.mix(frame(spark, rows[::-1])).collect())
    copies = collections.Counter(r.doc_id for r in mixing.mixed(frame(spark, rows)).collect())
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_token_counts_and_cache(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "test-cache")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = [*ROWS[:20], (900, "<|endoftext|> x  \n\n y\t", "en", "s", 0), (901, "", "en", "s", 0)]
    for some in (rows[:10], rows):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, some), path, cache).collect()}
        assert got == {d: len(plain.encode(x, add_special_tokens=False).ids) for d, x, *_ in some}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({x for _, x, *_ in rows})       # every content was encoded once over both calls
    # a count that is stored is used, and another version's is not
    digest = hashlib.sha256(b"new").digest()
    for version in (token_counts.version_of(path), "other"):
        spark.createDataFrame([(version, digest, 77 if version != "other" else 5)], token_counts.CACHE) \
            .write.mode("append").parquet(cache)
    assert token_counts.count_tokens(frame(spark, [(1, "new", "en", "s", 0)]), path, cache).first().n_tokens == 77


def test_words_are_encoded_once(monkeypatch):
    """Sums over pieces are the library's counts of whole texts, odd blanks, signs and special strings included."""
    import tokenizers

    path, asked, random_ = public_tokenizers.path("byte_bpe_50k.json"), [], random.Random(5)
    plain = tokenizers.Tokenizer.from_file(path)

    class Counted:
        def __init__(self, model):
            self.inner = model

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

    class Library:
        from_file = staticmethod(lambda p: Counted(plain))

    monkeypatch.setattr(tokenizers, "Tokenizer", Library)
    signs = ["a", "B", "don't", "'s", "'", ".", ",", "...", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x1d", "\x85", "\u00a0", "\u3000", "\u200b",
             "é", "e\u0301", "東", "7", "12", "-", "=", "<|endoftext|>", "<|endoftext", "|>", "🙂", "\x00"]
    texts = ["", " ", ". x", *("".join(random_.choices(signs, k=random_.randrange(1, 30))) for _ in range(3000))]
    count = token_counts.encoder(path)
    assert count(texts) == [[len(plain.encode(x, add_special_tokens=False).ids) for x in texts]]
    asked.clear()
    assert count(["one word. Another, word", "one word. one word", "one word"]) == [[6, 5, 2]]
    assert set(asked) <= {"one", " word", ".", " Another", ",", " one"} and len(asked) == len(set(asked))


def test_pieces_of_other_tokenizers(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(frame(spark, ROWS[:9]), path, fresh_path(spark, "test-cache")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(model.encode(x)) for d, x, *_ in ROWS[:9]}


def test_secrets(spark):
    text = ('My api-key: "abcdefgh12", APIKEY=short token=abc PASSWORD : "tok_en.VALUE-1234" AKIA1234 AKIAZZZZZZZZZZZZ99\n'
            f"md5 {'ab12' * 8} up {'0123456789abcdef' * 4}f random kJ8sQz72LmXv9TbR4wYc id 550e8400-e29b-41d4-a716-446655440000 "
            "international-standardisation 20240101-20250101")
    row = secrets.scan_secrets(frame(spark, [(1, text, "en", "s", 0)]), public_tokenizers.path("byte_bpe_50k.tiktoken")).first()
    found = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    assert (row.n_assign, row.n_access, row.n_hex, row.n_random) == (1, 1, 2, 1)
    assert ("random", "kJ8sQz72LmXv9TbR4wYc") in found and ("access", "AKIAZZZZZZZZZZZZ99") in found
    assert ("assign", 'PASSWORD : "tok_en.VALUE-1234') in found and ("hex", "ab12" * 8) in found
    assert set(row.base_spans.split(",")) <= set(row.spans.split(","))


def slow_random(text, n_tokens, ratio):
    signs = set(string.ascii_letters + string.digits + "+/_=-")
    found, start = [], None
    for i in range(len(text) + 1):
        inside = i < len(text) and (text[i] in signs or (
            text[i] == "." and start is not None and i + 1 < len(text) and text[i + 1] in signs and text[i - 1] in signs))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            rest = [p for p in text[start:i].split(".") if not secrets.KNOWN.fullmatch(p)]
            if len("".join(rest)) >= 16 and len("".join(rest)) < ratio * sum(map(n_tokens, rest)):
                found.append((start, 3, i))
            start = None
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["kQzJhVxW", "qPbNmTzRvKdLsXgF", "9Tb", ".", "..", " ", "=", "0123456789abcdef" * 2, "20240101", "ordinary", "é", "-", "\n", "Zx7"]), max_size=12))
def test_random_spans(parts):
    text = "".join(parts)
    for ratio in (1.5, 2.0, 30.0):
        def n_tokens(word):
            return 1 + len(word) * 2 // 3
        assert secrets.random_spans(text, n_tokens, ratio) == slow_random(text, n_tokens, ratio)


def test_letters_alone_can_be_random(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = ("key kQzJhVxWqPbNmTzRvKdLsXgF, jwt eyJhbGciOi9Qz2.kQ8Jx2VbNmTzR4vKd.LsXgFq7WpZ2cYt then internationalization "
            f"some/path/to/directory file-{'a1' * 16}.txt {'a1' * 32}.sha 10.20.30.40.50.60.70")
    row = secrets.scan_secrets(frame(spark, [(1, text, "en", "s", 0)]), path).first()
    found = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",")) if k == "random"]
    assert found[:2] == ["kQzJhVxWqPbNmTzRvKdLsXgF", "eyJhbGciOi9Qz2.kQ8Jx2VbNmTzR4vKd.LsXgFq7WpZ2cYt"]
    assert not any("internation" in x or "path" in x or x.endswith(".sha") or x.startswith("10.") for x in found)


SLOW = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    ["token", "SECRET", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGHIJ", "01f" * 6, "é", "x", "."]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    want = [(m.start(), 0, m.end()) for m in SLOW.finditer(text) if len(m[2]) >= 8]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert secrets.base_spans(text) == sorted(want)


def test_order_minhash(spark):
    rows = [*(r[:2] for r in ROWS[:30]), (900, ""), (901, "short"), (902, "漢字" * 30)]
    got = order_minhash.against_next(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()
    by, ids = dict(rows), [d for d, _ in rows]
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    for r in got:
        text, following = by[r.doc_id], by[after[r.doc_id]]
        n = len(text) // 4
        edited = text[:len(text) - n] + following[:n]
        own, changed, other = map(order_minhash.signature, (text, edited, following))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == own.astype(">u4").tobytes().hex()
        assert (r.near_edited, r.near_next) == ((own == changed).mean(), (own == other).mean())
    assert len(got) == len(rows)


def test_order_counts_in_fingerprints():
    """The same pieces in another order are less alike than a text with a few changed letters."""
    parts = [f"The {i * 7919 % 1000} part of a text about {zlib.crc32(str(i).encode())}. " for i in range(60)]
    text, turned = "".join(parts), "".join(parts[30:] + parts[:30])
    light = text[:900] + "!" + text[900:]
    like = [order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(x)) for x in (text, light, turned)]
    assert like[0] == 1.0 and like[1] > 0.7 and like[2] < like[1] - 0.15


def test_kmers_are_numbered_by_occurrence():
    once, twice = order_minhash.numbered_kmers("abcdefghijklm"), order_minhash.numbered_kmers("abcdefghijklm" * 3)
    assert len(set(twice.tolist())) == len(twice) and twice[0] == once[0]


def test_candidates_shuffle_postings_once(spark, tmp_path):
    """Both sides of the join of postings read one shuffle, whether or not lines are done already."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} same words here") for i in range(60)], "doc_id long, text string")
    nodes = line_dedup.prepared(docs).withColumnRenamed("at", "first").withColumn("todo", F.col("first.doc_id") % 2 == 0)
    nodes.write.parquet(str(tmp_path / "nodes"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = line_dedup.candidates(spark.read.parquet(str(tmp_path / "nodes")))
        found = pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found and "ReusedExchange" in plan


def test_long_lines_meet_only_near_copies(spark):
    """Long lines that share rare words are told apart in the join; those about the threshold are all met."""
    rng, rows, made = random.Random(8), [], []
    for i in range(40):
        base = rng.sample(range(4000), rng.randrange(90, 400))
        made.append((i, base))
        for share in (0.03, 0.1, 0.2):
            other = [w if rng.random() > share else rng.randrange(4000) for w in base]
            made.append((len(made) + 1000, other))
    rows = [(i, " ".join(f"w{w}" for w in ws)) for i, ws in made]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = line_dedup.prepared(docs).withColumnRenamed("at", "first").withColumn("todo", F.lit(True))
    by_hash = {r.l1: r.first.doc_id for r in nodes.select("l1", "first").collect()}
    met = {(by_hash[r.late], by_hash[r.early]) for r in line_dedup.candidates(nodes).collect()}
    sets = {i: set(ws) for i, ws in made}
    alike = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert alike <= met and len(alike) > 40
    assert len(met) < 4 * 40 * 6     # pairs within the groups of four at most


def test_parts_of_words_have_all_pairs(spark, tmp_path):
    """Pairs that meet in the parts of the words are those that meet at all; only long lines carry the wide classes."""
    rng = random.Random(21)
    bases = [rng.sample(range(900), rng.choice((8, 30, 110))) for _ in range(12)]
    rows = [(i, " ".join(f"w{w if rng.random() > 0.08 else rng.randrange(900)}" for w in bases[i % 12])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    line_dedup.prepared(docs).withColumnRenamed("at", "first").withColumn("todo", F.lit(True)).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    assert {(r.n >= line_dedup.LONG, r.wide is not None) for r in nodes.collect()} == {(True, True), (False, False)}
    parts = [set(map(tuple, line_dedup.candidates(nodes, part=i).collect())) for i in range(line_dedup.PASSES)]
    assert set().union(*parts) == set(map(tuple, line_dedup.candidates(nodes).collect())) and all(parts)
