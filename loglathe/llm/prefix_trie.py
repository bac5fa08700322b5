"""A trie of conversations, built the way burst tries are.

A conversation is a sequence of turns (role, text); a node of the trie is a distinct prefix. Equal
sequences are one row from the start, with their number of members. Containers hold the sequences
below one trie head. A container with too many turns bursts: the prefix that all its sequences
share becomes a chain of heads, and its sequences go to new containers by their next turn id. What
is left are containers that fit a task; each is sorted and swept once into its nodes. Heads are few
(every one of them stands over more turns than a container may hold) and are summed up at the end.

Turn ids are 128-bit digests of role and text, so texts travel once. A sequence is one row: a single
conversation must fit a task, the conversations below one prefix need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import keep
from loglathe.operators.sizes import join_small

#: Turns below a head that one container may hold.
CONTAINER = 50_000
#: Conversation ids that are written out as one piece before pieces are digested in order.
PIECE = 256
NOTHING = hashlib.sha256(b"").hexdigest()

def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation, in the order of ``turn``, nulls first, then role, then turn id.

    A turn is (id, cp): a digest of role and text, and the text's code points. Null roles and
    texts are empty. Rows without a conv_id take no part; a row repeated whole is a turn of its own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("at"), role.alias("role"), F.unhex(F.md5(both.cast("binary"))).alias("id"),
        F.char_length(text).cast("long").alias("cp"))
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["cp"].alias("cp"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the block's first conversation, then the own turns after the first h.

    h is the unsigned crc32 of the id in decimals, modulo ``most``. A first conversation that isn't
    there gives no turns.
    """
    own = keep(sequences(conversations), "trie-sequences")
    first = F.col("conv_id") - F.col("conv_id") % block
    heads = own.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast("array<struct<id:binary,cp:bigint>>"))
    rest = F.filter("turns", lambda x, i: i >= F.col("h"))
    return own.withColumns({"first": first, "h": h}).join(heads, "first", "left").select(
        "conv_id", F.concat(lead, rest).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(seq, sha): the digest of every sequence's member ids, ascending, joined by commas.

    Ids are first joined in pieces of a fixed id range, in parallel; then a task reads a sequence's
    pieces in order and holds no more than one of them.
    """
    pieces = members.groupBy("seq", F.floor(F.col("conv_id") / PIECE).cast("long").alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != held:
                    if digest is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = seq, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["seq", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["seq", "sha"])

    return pieces.repartition("seq").sortWithinPartitions("seq", "piece").select("seq", "ids").mapInArrow(
        run, "seq binary, sha string")


def _distinct(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence: seq, n, conv, ids, cps, sha."""
    joined = F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "").cast("binary")
    rows = keep(convs.select("conv_id", F.unhex(F.md5(joined)).alias("seq"), "turns"), "trie-rebuilt")
    once = rows.groupBy("seq").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("turns").alias("turns"))
    return once.join(_ends(rows.select("seq", "conv_id")), "seq").select(
        "seq", "n", "conv", F.col("turns.id").alias("ids"), F.col("turns.cp").alias("cps"), "sha")


def _prefix(ids, n) -> F.Column:
    """Names the prefix of ``n`` turns."""
    return F.md5(F.array_join(F.transform(F.slice(ids, F.lit(1), n), lambda x: F.hex(x)), "").cast("binary"))


def _burst(seqs: DataFrame, container: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(containers, heads): sequences with the container they end up in, and the head prefixes burst on the way.

    Containers have key, depth (turns of the prefix they hang at), under (the key of the head above
    them, null at the top) and ``at_end``: whether they are just the sequence that ends at that head.
    """
    active, settled, heads = seqs, [], []
    while True:
        sizes = active.groupBy("key").agg(
            F.count("*").alias("k"), F.sum(F.size("ids") - F.col("depth")).alias("below"),
            F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("cps", "ids").alias("cps"))
        over = keep(sizes.where((F.col("k") > 1) & (F.col("below") > container)).select("key", "low", "high", "cps"), "trie-over")
        if over.isEmpty():
            return [*settled, active], heads
        # all sequences between the least and the greatest share what these two share
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size("low")).cast("int")
        over = over.select("key", F.least(shared, F.size("low"), F.size("high")).alias("cut"), "low", "cps").select(
            "key", "cut", _prefix(F.col("low"), F.col("cut")).alias("head"), "low", "cps")
        heads.append(over.select(
            "head", "cut", F.slice("low", F.lit(1), F.col("cut")).alias("ids"), F.slice("cps", F.lit(1), F.col("cut")).alias("cps")))
        marked = join_small(active, over.select("key", "cut", "head"), ["key"], "left", spread="seq")
        ends = F.size("ids") == F.col("cut")
        moved = keep(marked.select(
            *[c for c in seqs.columns if c not in ("key", "depth", "under", "at_end")],
            F.when(F.col("cut").isNull(), F.col("key")).when(ends, F.concat(F.lit("end of "), F.col("head")))
            .otherwise(_prefix(F.col("ids"), F.col("cut") + 1)).alias("key"),
            F.coalesce(F.when(ends, F.col("cut")).otherwise(F.col("cut") + 1), F.col("depth")).alias("depth"),
            F.coalesce("head", "under").alias("under"),
            F.coalesce(F.when(F.col("cut").isNotNull(), ends), F.col("at_end")).alias("at_end"),
            F.col("cut").isNotNull().alias("open")), "trie-containers")
        settled.append(moved.where("not open or at_end").drop("open"))
        active = moved.where("open and not at_end").drop("open")


_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, under string, top boolean, at_end boolean")


def sweep(rows: list[tuple], depth: int) -> list[tuple]:
    """Nodes of one container, its head prefix of ``depth`` turns first.

    ``rows`` are (ids, cps, n, conv, sha). Sorted by their ids, a node's sequences stand together, so
    a stack of the current path is all that is needed: a node is done when the path leaves it.
    """
    rows = sorted(rows, key=lambda r: r[0])
    out: list[list] = []
    path: list[list] = []              # nodes from the head down: conv, depth, parent, n, children, leaves, saved, sha, cp

    def leave(to: int) -> None:
        while len(path) > to:
            node = path.pop()
            cp = node.pop()
            if not node[4]:
                node[5] = 1
            node[6] += (node[3] - 1) * cp
            if path:
                up = path[-1]
                up[4] += 1
                up[5] += node[5]
                up[6] += node[6]
                up[3] += node[3]
                up[0] = min(up[0], node[0])

    before: list = []
    for ids, cps, n, conv, sha in rows:
        same, most = depth, min(len(ids), len(before))
        if path:
            while same < most and ids[same] == before[same]:
                same += 1
            leave(same - depth + 1)
        for d in range(depth + len(path), len(ids) + 1):
            node = [conv, d, path[-1] if path else None, 0, 0, 0, 0, NOTHING, cps[d - 1] if d else 0]
            out.append(node)
            path.append(node)
        last = path[-1]
        last[7] = sha
        last[3] += n
        last[0] = min(last[0], conv)
        before = ids
    leave(0)
    return [(x[0], x[1], x[2][0] if x[2] else None, *x[3:8]) for x in out]


def _swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; a sequence that ends at a head gives one row that stands for it."""
    names = [x.split()[0] for x in _NODE.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in _NODE.split(", ")]

    def nodes(rows: list[tuple], depth: int, under: str | None, at_end: bool) -> list[tuple]:
        return [(*x, under, i == 0, at_end) for i, x in enumerate(sweep(rows, depth))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, about = None, [], ()

        def packed(done):
            cols = list(zip(*done, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for key, depth, under, at_end, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held:
                    if rows:
                        done += nodes(rows, *about)
                    held, rows, about = key, [], (depth, under, at_end)
                    if len(done) >= CONTAINER:
                        yield packed(done)
                        done = []
                rows.append(tuple(row))
            yield packed(done)
        if rows:
            yield packed(nodes(rows, *about))

    return containers.select("key", "depth", "under", "at_end", "ids", "cps", "n", "conv", "sha").repartition(
        "key").sortWithinPartitions("key").mapInArrow(run, _NODE)


def _heads(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes of the head prefixes: what hangs directly below each burst prefix, summed along its path."""
    tops = nodes.where("top").groupBy("under").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv"), F.sum(F.when(F.col("at_end"), 0).otherwise(F.col("n_leaves"))).alias("leaves"),
        F.sum(F.when(F.col("at_end"), 0).otherwise(F.col("saved_tokens"))).alias("saved"),
        F.sum(F.when(F.col("at_end"), 0).otherwise(1)).alias("kids"), F.max(F.when(F.col("at_end"), F.col("ends_sha256"))).alias("sha"))
    burst = keep(heads.join(tops, heads["head"] == tops["under"], "left").select(
        "cut", "cps", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "leaves", "saved", "kids")], "conv", "sha",
        F.transform(F.sequence(F.lit(0), F.col("cut")), lambda d: _prefix(F.col("ids"), d)).alias("path")), "trie-heads")
    # every burst prefix counts for itself and for every head above it
    along = burst.select("*", F.posexplode("path").alias("d", "node"))
    own = F.col("d") == F.col("cut")
    edges = along.groupBy("node", F.get("path", F.col("d") + 1).alias("child")).agg(
        F.first("d").alias("d"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.sum(F.when(own, F.col("kids")).otherwise(0)).alias("kids"),
        F.max(F.when(own, F.col("sha"))).alias("sha"), F.first(F.slice("path", F.lit(1), F.col("d") + 1)).alias("path"),
        F.first(F.coalesce(F.get("cps", F.col("d") - 1), F.lit(0).cast("long"))).alias("cp"))
    sums = keep(edges.groupBy("node").agg(
        F.first("d").alias("d"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), (F.sum("kids") + F.count("child")).alias("kids"), F.max("sha").alias("sha"),
        F.first("path").alias("path"), F.first("cp").alias("cp")), "trie-head-sums")
    shared = sums.select(F.explode("path").alias("node"), ((F.col("n") - 1) * F.col("cp")).alias("own")).groupBy("node").agg(
        F.sum("own").alias("own"))
    above = sums.select(F.col("node").alias("up"), F.col("conv").alias("parent_conv_id"))
    full = sums.join(shared, "node").withColumn("up", F.get("path", F.col("d") - 1))
    return full.join(above, "up", "left").select(
        "node", F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


def trie(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row for each node of the trie over (conv_id, turns).

    conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over the
    subtree, (n_convs - 1) times the code points of the node's last text) and ends_sha256 (members
    that end here, ascending, joined by commas). Without conversations there is no root and no row.
    """
    # all in one container at first; its columns are written, so that joins on them stay joins by key
    seqs = keep(_distinct(convs).select(
        "*", F.lit("").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("under"),
        F.lit(False).alias("at_end")), "trie-distinct")
    settled, heads = _burst(seqs, container)
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    nodes = keep(_swept(containers), "trie-nodes")
    plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not heads:
        return nodes.select(plain)
    burst = heads[0]
    for more in heads[1:]:
        burst = burst.unionByName(more)
    upper = keep(_heads(nodes, burst), "trie-upper")
    above = upper.select(F.col("node").alias("under"), F.col("conv_id").alias("above"))
    tops = join_small(nodes.where("top and not at_end"), above, ["under"], "left", spread="conv_id")
    lower = nodes.where("not top").select(plain).unionByName(
        tops.select(*[F.col("above").alias(c) if c == "parent_conv_id" else F.col(c) for c in plain]))
    return upper.select(plain).unionByName(lower)
