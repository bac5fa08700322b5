"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters.

DataFrame functions only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.base import free_name, keep, release, text_key

THRESHOLD = 0.8
#: Lines of fewer different tokens are left alone: only blank lines are.
MIN_TOKENS = 1
#: Rarity is counted in so many buckets of word hashes: a table of fixed size, whatever the vocabulary.
BUCKETS = 1 << 18
_HASH_BITS = 55
#: Class of rarity of a bucket that counted one word in all: no other line has that word.
_ALONE = 8
#: Classes of words for the test of pairs before their texts are fetched.
WIDE = 256
#: Lines of so many words have these classes: beyond it, 64 classes are too few to tell lines apart.
LONG = 96
#: The join of postings goes by so many parts of all words, one after the other, so that their shuffles don't add up on disk.
PASSES = 3
#: So many words name the groups whose heads a line is tested against first.
NAMES = 3
#: A group has so many heads: the earliest line of each class of line hashes.
HEADS = 8
#: So many times more candidates of a line are tested in each round than in the one before: all that ``head_pairs`` gives by the second.
ROUND = 32
#: Lines are told by a bitmap before their texts are shuffled: bits for each of them, and at most 2 to this power in all.
_BITS_EACH, _MOST_BITS = 8, 26


def _words(line: Column) -> Column:
    """Lower-cased words between blanks, tabs and carriage returns; an empty one for each blank too many."""
    spaced = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.split(spaced, " ")


def tokens(line: Column) -> Column:
    """The different words of a line."""
    return F.array_remove(F.array_distinct(_words(line)), "")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of every text (null: empty) with its place and two hashes of its characters."""
    text = F.coalesce("text", F.lit(""))
    placed = docs.select("doc_id", text_key().alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return placed.select(
        F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "line_no").alias("at"), "line",
        F.xxhash64("line").alias("l1"), F.xxhash64("line", F.lit(1)).alias("l2"))


def _hashed(line: Column) -> Column:
    """64-bit hashes of a line's different words."""
    hashes = F.transform(_words(line), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def _rarity(docs: DataFrame) -> DataFrame:
    """One row: for each bucket a class from 0 (no word) to 255, ascending with its number of words."""
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    words = _words(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))   # those of all lines
    counts = docs.select(F.explode(words).alias("word")).groupBy(bucket.alias("bucket")).count()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    level = F.least(F.lit(255), F.floor(8 * F.log2(F.coalesce("count", F.lit(0)) + 1))).cast("smallint")
    listed = every.join(counts, "bucket", "left").select(F.struct("bucket", level.alias("level")).alias("x"))
    return listed.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.col("x.level").alias("levels"))


def _ordered(hashes: Column, levels: Column) -> Column:
    """Words as numbers, rarest first: class of rarity, then the hash without its highest bits. ``levels`` has the classes once for each word."""
    return F.sort_array(F.zip_with(hashes, levels, lambda h, of: F.shiftleft(
        F.coalesce(F.get(of, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)).cast("long"), _HASH_BITS
    ).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))))


def _least(of: Column) -> Column:
    return F.ceil(of - 1e-9).cast("int")


def prepared(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(at, l1, l2, n, parity, wide, alone, prefix) of every line.

    Of the rarest n - ceil(t n) + 1 words, the first ``alone`` are in no other line; ``prefix`` holds 31 bits of the hash
    of each of the rest (words that meet by chance are told apart later). ``parity`` has, for each of 64 classes of
    words, whether the line's number of them is odd, and ``wide`` of ``LONG`` lines the same for ``WIDE`` classes more.
    """
    lines = _lines(docs)
    # a table of BUCKETS small numbers; as a subquery it is a value of the job, and no text of the plan has it
    levels = _rarity(docs).scalar()
    hashed = lines.select("at", "l1", "l2", _hashed(F.col("line")).alias("hashes"))
    # a function of words may not hold a subquery, so the table stands beside each word: references to one value,
    # as the next projection takes this one in (each of its columns is used once)
    beside = hashed.select("at", "l1", "l2", "hashes", F.array_repeat(levels, F.size("hashes")).alias("levels"))
    numbered = beside.select("at", "l1", "l2", _ordered(F.col("hashes"), F.col("levels")).alias("words"))
    n = F.size("words")
    bit = F.expr("aggregate(words, 0L, (bits, w) -> bits ^ shiftleft(1L, CAST(w & 63 AS INT)))")
    # classes by other bits of the hash, 64 to a number
    wide = F.array(*[F.expr(
        f"aggregate(filter(words, w -> (shiftright(w, 6) & {WIDE // 64 - 1}) = {i}), 0L, (bits, w) -> bits ^ shiftleft(1L, CAST(shiftright(w, 16) & 63 AS INT)))")
        for i in range(WIDE // 64)])
    rare = numbered.select(
        "at", "l1", "l2", n.alias("n"), bit.alias("parity"), F.when(n >= LONG, wide).alias("wide"),
        F.slice("words", 1, n - _least(threshold * n) + 1).alias("rare"))
    shared = F.transform(F.filter("rare", _shared), lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # rarest first, so words that no other line has stand before all others
    return rare.withColumn("prefix", shared).select(
        "at", "l1", "l2", "n", "parity", "wide", (F.size("rare") - F.size("prefix")).alias("alone"), "prefix")


def _may_be_alike(x, y, threshold: float) -> Column:
    """Length and parity filter of two rows given as functions from a name to a column.

    Lengths may differ by the factor t at most, and words that only one line has, at most
    (1-t)/(1+t) of both lengths, are no fewer than the parities that differ.
    """
    odd = F.bit_count(x("parity").bitwiseXOR(y("parity")))
    return (F.least(x("n"), y("n")) >= _least(threshold * F.greatest(x("n"), y("n")))) & (
        odd <= _apart(x("n") + y("n"), threshold))


def _apart(both: Column, threshold: float) -> Column:
    """At most so many words are in only one of two alike lines with ``both`` words together."""
    return (1 - threshold) / (1 + threshold) * both + 1e-9


def _odd_words(a: str, b: str) -> Column:
    """Classes of words whose parities differ; each needs a word that only one of both lines has. 0 if not both are ``LONG``."""
    odd = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WIDE // 64)]
    return F.coalesce(sum(odd[1:], odd[0]), F.lit(0))


def _shared(word: Column) -> Column:
    """Whether other lines may have the word."""
    return F.shiftright(word, _HASH_BITS) > _ALONE


def _names(shared: Column) -> Column:
    """Words that name a line's groups: the rarest, and those of the least hashes among the rarest.

    Near copies differ in rare words, so a name by rarity alone is often one that the group doesn't share.
    """
    # the hash, then the word, as one number
    hashed = F.sort_array(F.transform(shared, lambda w: F.shiftleft(F.hash(w).cast("long"), 32).bitwiseOR(w.cast("long"))))
    least = F.transform(F.slice(hashed, 1, NAMES - 1), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return F.array_distinct(F.concat(F.slice(shared, 1, 1), least))


def head_pairs(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(late, early): each line with the earlier heads of each group that its ``_names`` name.

    At most ``NAMES`` times ``HEADS`` pairs a line, however large the group. A line that is like
    an earlier head needs no other match; the rest go through ``candidates``. Rows carry the document only;
    lines of one document are put in order afterwards.
    """
    doc = F.col("first.doc_id")
    named = nodes.select(
        "l1", "n", "parity", F.struct(doc.isNull().alias("no"), doc.alias("id")).alias("doc"), F.explode(_names(F.col("prefix"))).alias("word"))
    heads = named.groupBy("word", F.pmod("l1", F.lit(HEADS))).agg(F.min(F.struct("doc", "l1", "n", "parity")).alias("head")).select("word", "head")
    met = named.join(heads, "word").where(
        (F.col("head.doc") <= F.col("doc")) & (F.col("head.l1") != F.col("l1"))
        & _may_be_alike(F.col, lambda c: F.col(f"head.{c}"), threshold))
    return met.select(F.col("l1").alias("late"), F.col("head.l1").alias("early")).distinct()


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, part: int | None = None) -> DataFrame:
    """(late, early): pairs of ``l1`` that may be as like as ``threshold``, the later line ``todo``; none that are is missing.

    Two alike lines share a word among the rarest n - ceil(t n) + 1 of the longer and the rarest
    n - ceil(2t/(1+t) n) + 1 of the shorter; only these are joined, without words that only one
    line has. What is left behind the shared word's places must still reach the overlap that t
    asks for, and the pair must pass ``_may_be_alike``, by all classes where both lines are ``LONG``. Any order of words that all lines share
    keeps this exact; rare ones first keeps the lists short.

    A pair tells something about its later line only, so lines that already have a match are met
    as earlier ones, never as later ones: the first line of a group of near copies meets none of
    them. Postings carry the document for that; lines of one document are put in order afterwards.

    ``part`` asks for the pairs that meet in one of ``PASSES`` parts of the words; the parts together have them all.
    """
    t = threshold
    tag = F.shiftleft("n", 1) + F.col("todo").cast("int")
    postings = nodes.select(
        "l1", tag.alias("tag"), "parity", "wide", F.col("first.doc_id").alias("doc"), "alone",
        F.posexplode("prefix").alias("place", "word")).withColumn("place", F.col("place") + F.col("alone"))
    if part is not None:
        postings = postings.where(F.col("word") % PASSES == part)

    def side(s):
        return postings.select("word", *[F.col(c).alias(f"{c}_{s}") for c in ("l1", "tag", "place", "parity", "wide", "doc")])

    def of(s):
        return lambda c: F.shiftright(f"tag_{s}", 1) if c == "n" else F.col(f"{c}_{s}")

    def in_short_prefix(s):
        return F.col(f"place_{s}") <= of(s)("n") - _least(2 * t / (1 + t) * of(s)("n"))

    a, b, n_a, n_b = side("a"), side("b"), of("a")("n"), of("b")("n")
    # Both sides are the same rows and columns, so Spark shuffles them once. A test of ``todo`` on one side alone
    # would be pushed below that shuffle and make it two; as part of the pair (tags are above 0) it stays in the join.
    late = F.col("tag_a").bitwiseAND(F.lit(1)) * F.col("tag_b") > 0
    shorter = (n_a < n_b) | ((n_a == n_b) & (F.col("l1_a") < F.col("l1_b")))
    left_over = F.least(n_a - F.col("place_a"), n_b - F.col("place_b"))
    met = a.join(b, (a.word == b.word) & (F.col("l1_a") != F.col("l1_b")) & late
                 & (F.col("doc_a").isNull() | (F.col("doc_b") <= F.col("doc_a")))    # null ids are last
                 & ((shorter & in_short_prefix("a")) | (~shorter & in_short_prefix("b")))
                 & (left_over >= _least(t / (1 + t) * (n_a + n_b)))
                 & _may_be_alike(of("a"), of("b"), t)
                 & (_odd_words("wide_a", "wide_b") <= _apart(n_a + n_b, t)))
    return met.select(F.col("l1_a").alias("late"), F.col("l1_b").alias("early")).distinct()


def _bits_for(most: int) -> int:
    """So many bits (a power of two) tell ``most`` lines from others well."""
    return 1 << min(_MOST_BITS, max(12, (_BITS_EACH * most - 1).bit_length()))


def maybe_in(met: DataFrame, bits: int) -> Column:
    """Whether a row's ``l1`` may be one of ``met``: true for all that are and, by chance, for some that aren't.

    A bitmap of bounded size (8 MB at most), filled by Spark, that tasks get as the value of a subquery; a join
    after it gives the exact rows, but only those that pass are shuffled.
    """
    part, bit = F.shiftright("l1", 6).bitwiseAND(F.lit(bits // 64 - 1)), F.col("l1").bitwiseAND(F.lit(63)).cast("int")
    filled = met.groupBy(part.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(l1 & 63 AS INT))")).alias("set"))
    every = met.sparkSession.range(bits // 64).join(filled, "id", "left").select(
        F.struct("id", F.coalesce("set", F.lit(0).cast("long")).alias("set")).alias("x"))
    row = every.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.col("x.set").alias("sets"))
    return F.getbit(F.get(row.scalar(), part.cast("int")), bit) == 1


def with_earlier_match(lines: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(l1, l2) of every ``late`` node of ``pairs`` that is as like as ``threshold`` to an ``early`` one before it.

    Candidates are tested on the words themselves, fetched from ``lines`` once. Which of several
    earlier lines a line repeats makes no difference, so its earliest candidate is tested first,
    and only a line without a match goes on to its next candidates, up to the 32nd, the 1024th, ...,
    until it has one or has none left. So the texts that travel are about two for each line, however
    many lines a group of near copies has, and no candidate is passed over. Candidates are numbered
    once, and a round that is the last writes no rest: each table costs the driver a plan and tasks.
    """
    place = nodes.select("l1", "l2", "first", "n", "wide")

    def side(df, s, *columns):
        return df.select(F.col("l1").alias(s), F.col("l2").alias(f"{s}2"), *[F.col(c).alias(f"{s}_{c}") for c in columns])

    facts = ("first", "n", "wide")
    names = ("late", "late2", "early", "early2")
    turn = F.row_number().over(Window.partitionBy("late", "late2").orderBy("early_first", "early", "early2"))
    todo = keep(
        pairs.join(side(place, "late", *facts), "late").join(side(place, "early", *facts), "early").where(
            (F.col("early_first") < F.col("late_first"))
            & (_odd_words("late_wide", "early_wide") <= _apart(F.col("late_n") + F.col("early_n"), threshold))).select(
            *names, turn.alias("turn")),
        "line-todo")
    met = todo.select(F.col("late").alias("l1")).union(todo.select("early")).distinct()
    many, last = todo.agg(F.count("*"), F.max("turn")).first()
    few = lines.select("l1", "l2", "line").where(maybe_in(met, _bits_for(2 * many)))
    texts = keep(few.join(met, "l1", "left_semi").groupBy("l1", "l2").agg(F.first("line").alias("line")), "line-texts")
    found, most = None, 1
    while True:
        tested = (
            todo.where(F.col("turn") <= most).select(*names)
            .join(side(texts, "late", "line"), ["late", "late2"]).join(side(texts, "early", "line"), ["early", "early2"]))
        x, y = tokens(F.col("late_line")), tokens(F.col("early_line"))
        sizes = tested.select("late", "late2", F.size(F.array_intersect(x, y)).alias("o"), (F.size(x) + F.size(y)).alias("sum"))
        like = F.col("o") >= threshold * (F.col("sum") - F.col("o")) - 1e-9
        yes = keep(sizes.where(like).select("late", "late2").distinct(), "line-repeats")
        found = yes if found is None else found.unionAll(yes)
        rest = None
        if (last or 0) > most:
            rest = keep(todo.where(F.col("turn") > most).join(yes, ["late", "late2"], "left_anti"), "line-todo")
            last = rest.agg(F.max("turn")).first()[0]
        release(todo)
        if rest is None or last is None:
            release(texts, *([] if rest is None else [rest]))
            return found.select(F.col("late").alias("l1"), F.col("late2").alias("l2"))
        todo, most = rest, most * ROUND


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, key, line_no) of every line with an earlier line that is as like as ``threshold``.

    Earlier means a lesser (doc_id, text key, line number), null ids last. Equal lines are one node
    of the join, with the first place they stand at; all places after it are repeats, and that one
    is if another line before it is alike. Lines of under ``min_tokens`` different words never are.
    """
    facts = ("n", "parity", "wide", "alone", "prefix")
    nodes = keep(
        prepared(docs, threshold).groupBy("l1", "l2").agg(
            F.min("at").alias("first"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in facts]).where(F.col("n") >= min_tokens),
        "line-nodes")
    lines = _lines(docs)
    # pairs are written before their lines are fetched, so that the shuffles of both don't add up
    heads = keep(head_pairs(nodes, threshold), "line-pairs")
    early = keep(with_earlier_match(lines, nodes, heads, threshold).withColumn("done", F.lit(True)), "line-heads")
    # one table that all parts of the join of postings read
    open_ = keep(
        nodes.join(early, ["l1", "l2"], "left").select(
            "l1", "n", "parity", "wide", "alone", "prefix", F.struct("first.doc_id").alias("first"), F.col("done").isNull().alias("todo")),
        "line-open")
    parts = [keep(candidates(open_, threshold, i), "line-pairs") for i in range(PASSES)]
    release(open_)
    met = functools.reduce(DataFrame.unionAll, parts).distinct()
    late = early.select("l1", "l2").unionAll(
        with_earlier_match(lines, nodes, met, threshold)).distinct().withColumn("repeats", F.lit(True))
    cut = keep(
        nodes.select("l1", "l2", "first", "times").join(late, ["l1", "l2"], "left")
        .where("times > 1 OR repeats").select("l1", "l2", "first", F.coalesce("repeats", F.lit(False)).alias("repeats")),
        "line-cuts")
    release(nodes, early, heads, *parts)
    return _lines(docs).select("at", "l1", "l2").join(cut, ["l1", "l2"]).where("repeats OR at > first").select(
        "at.doc_id", "at.key", "at.line_no")


def _removals(docs: DataFrame, threshold: float, min_tokens: int) -> DataFrame:
    """(its_id, its_key, removed) of every document with repeats; ``removed`` holds line numbers, in order."""
    again = repeated_lines(docs, threshold, min_tokens).distinct()  # a row repeated whole is one document
    return again.groupBy(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key")).agg(
        F.sort_array(F.collect_list("line_no")).alias("removed"))


def line_report(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined) of every row of ``docs``."""
    slim = docs.select("doc_id", text_key().alias("key"),
                       F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    gone = _removals(docs, threshold, min_tokens)
    both = slim.join(gone, slim.doc_id.eqNullSafe(gone.its_id) & (slim.key == gone.its_key), "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("removed", none)
    return both.select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Every row of ``docs`` without its repeated lines; ``n_chars``, where there is one, counts what is left.

    Null and empty texts stay as they are, and so does every other column. All rows of one
    (doc_id, text) lose the same lines.
    """
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, text_key())
    gone = _removals(docs, threshold, min_tokens)
    both = keyed.join(gone, keyed.doc_id.eqNullSafe(gone.its_id) & (keyed[name] == gone.its_key), "left")
    lines = F.split(keyed.text, "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    # numbers that stay, by a set of those that go: linear in the lines of a text
    lines = F.transform(F.array_except(every, gone.removed), lambda i: F.get(lines, i))
    text = F.when(gone.removed.isNull(), keyed.text).otherwise(F.array_join(lines, "\n"))
    made = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        left = F.when(gone.removed.isNull(), keyed.n_chars).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
        made["n_chars"] = left.alias("n_chars")
    return both.select(*[made.get(c, keyed[c]) for c in docs.columns])
