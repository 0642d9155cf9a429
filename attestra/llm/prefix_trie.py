"""Trie of conversation prefixes by partition refinement.

All conversations start in one class. A step splits every active class by its members'
next turns; a class of one member is retired at once and its tail emitted as a chain of
single nodes, without looking at the tail's turns. What stays together is split on, first
by one turn a step, then by twice as many each time up to CHUNK, as members that share
much are likely to share more: the number of jobs grows with the logarithm of the shared
depth until it reaches CHUNK, with a CHUNK-th of it beyond. Sums over subtrees are folded
back from the deepest step to the first.

A class is labelled by the digest of its parent's label and its members' turn, so a split
is one grouping with partial sums and a hot class or a group of copies is a row for each
task. Members leave by an anti-join on their own number, children find their parent's
smallest member by a shuffled join but for the at most HOT parents with the most children,
which are broadcast. Texts never leave the first scan: turns travel as 16-byte digests and
word counts, in arrays of at most CHUNK turns. A conversation of more than LONG turns is
numbered in slices of its order. Ids that end at one node are sorted by range over all
tasks and streamed through one digest.

Defined cases: null turns come first; turns with equal numbers follow the digest of role
and text, so repeated rows stand next to each other, each one a turn; a null role or text
is empty; rows without conv_id belong to no conversation and are left out; an empty table
has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm._shared import written
from attestra.operators import ranking

#: Turns in an array, and the most that one step splits by.
CHUNK = 64
#: Conversations of more turns are numbered slice by slice.
LONG = 1_000_000
#: Parents that are broadcast to their children, at most.
HOT = 2_000
#: Nodes of a chain made at once.
_RUN = 4_096
ROOT = hashlib.md5(b"").digest()
NONE = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _turns(conversations: DataFrame, block: int) -> DataFrame:
    """block, conv_id, turn, key, words: without texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    key = _digest(F.char_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where(conv.isNotNull()).select((conv - conv % block).alias("block"), conv.alias("conv_id"), F.col("turn"), key.alias("key"), words.alias("words"))


def _heads(turns: DataFrame, most: int) -> DataFrame:
    """The first turns, at most ``most``, of every conversation that others of its block begin with: block, heads."""
    first = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key"))
    some = turns.where("conv_id = block").withColumn("pos", first).where(F.col("pos") <= most)
    return some.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("heads"))


def _chunked(rows: DataFrame, mod: int) -> DataFrame:
    """Rebuilt conversations (conv_id, n, chunk, keys, words) from rows with pos, n and their block's heads."""
    h = F.crc32(F.col("conv_id").cast("string")) % mod
    rows = rows.withColumn("h", h.cast("int")).withColumn("heads", F.slice(F.coalesce("heads", F.array().cast("array<struct<pos:int,key:binary,words:bigint>>")), F.lit(1), F.col("h")))
    k = F.size("heads")
    turn = lambda at, key, words: F.struct(at.cast("long").alias("at"), key.cast("binary").alias("key"), words.cast("long").alias("words"))
    nothing = F.array().cast("array<struct<at:bigint,key:binary,words:bigint>>")
    total = (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")
    own = F.when(F.col("pos") > F.col("h"), F.array(turn(k + F.col("pos") - F.col("h"), F.col("key"), F.col("words")))).otherwise(nothing)
    lent = F.when(F.col("pos") == 1, F.transform("heads", lambda x, i: turn(i + 1, x["key"], x["words"]))).otherwise(nothing)
    none = F.when((F.col("pos") == 1) & (total == 0), F.array(turn(F.lit(0), F.lit(None), F.lit(None)))).otherwise(nothing)
    each = rows.select("block", "conv_id", total.alias("total"), F.explode(F.concat(lent, own, none)).alias("t"))
    chunk = F.floor(F.greatest(F.col("t.at") - 1, F.lit(0)) / CHUNK).cast("long")
    packed = each.groupBy("block", "conv_id", "total", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("t")).alias("t"))
    real = F.filter("t", lambda x: x["at"] > 0)
    return packed.select("conv_id", F.col("total").alias("n"), "chunk", F.transform(real, lambda x: x["key"]).alias("keys"), F.transform(real, lambda x: x["words"]).alias("words"))


def rebuilt(conversations: DataFrame, block: int = 20, mod: int = 4) -> DataFrame:
    """Every conversation c, begun by the first h turns of c - c % block, then its own turns after its first h; h = crc32(c) % mod. One row for each CHUNK turns: conv_id, n (turns in all), chunk, keys, words."""
    turns = _turns(conversations, block)
    heads = _heads(turns, mod - 1)
    here = W.partitionBy("block", "conv_id")

    def usual(some: DataFrame) -> DataFrame:
        some = some.repartition("block").withColumn("pos", F.row_number().over(here.orderBy(F.col("turn").asc_nulls_first(), "key"))).withColumn("n", F.count("*").over(here))
        return _chunked(some.join(heads, "block", "left"), mod)

    long = written(turns.groupBy("block", "conv_id").count().where(F.col("count") > LONG).select("block", "conv_id"), "long")  # at most a row for each LONG turns
    if long.isEmpty():
        return usual(turns)
    ids = F.broadcast(long.select("conv_id"))
    ranked = ranking.running(turns.join(ids, "conv_id", "left_semi"), ["conv_id"], [F.col("turn"), F.col("key")])
    lent = F.broadcast(long.join(heads, "block", "left").select("conv_id", "heads"))
    rest = ranked.withColumnRenamed("upto", "pos").withColumnRenamed("total", "n").join(lent, "conv_id")
    return usual(turns.join(ids, "conv_id", "left_anti")).unionByName(_chunked(rest, mod))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(cls, ends_sha256) of rows (cls, conv_id): pieces of sorted ids, made by range of class and id, then streamed in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, ids = batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist()
            at = [i for i in range(len(cls)) if not i or cls[i] != cls[i - 1]]
            if at:
                spans = list(zip(at, [*at[1:], len(cls)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in at], pa.binary()), pa.array([ids[i] for i in at], pa.int64()), pa.array([",".join(map(str, ids[i:j])) for i, j in spans])], names=["cls", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for cls, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if cls != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = cls, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield row(out)
        if sha is not None:
            yield row([(now, sha.hexdigest())])

    def row(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["cls", "ends_sha256"])

    ranged = ends.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(pieces, "cls binary, first long, ids string")
    return ranged.repartition("cls").sortWithinPartitions("cls", "first").mapInArrow(digests, "cls binary, ends_sha256 string")


def _union(some: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, some)


def _refined(chunks: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(classes of several members and retired members of each step, ends).

    Classes: path (from the class that the step began with to this one), depth, words,
    n_convs, conv_id, n_ends. Retired: conv_id, n, depth and path of the first node that
    is theirs alone. Ends: cls, conv_id of members that end in a class of several or at
    the root.
    """
    first = chunks.where("chunk = 0").withColumn("cls", F.lit(ROOT))
    ends = [first.where("n = 0").select("cls", "conv_id")]
    state, levels, retired = first.where("n > 0").select("conv_id", "n", "cls", "keys", "words"), [], []
    at = 0
    while not state.isEmpty():
        inside = at % CHUNK
        size = min(max(1, inside), CHUNK - inside) if at < CHUNK else CHUNK
        down = lambda path, key: F.concat(path, F.array(_digest(F.element_at(path, -1), key)))
        moves = state.withColumn("path", F.aggregate(F.slice("keys", inside + 1, size), F.array("cls"), down))
        each = moves.select("conv_id", "n", "path", F.posexplode(F.slice("words", inside + 1, size)).alias("i", "of"))
        path = F.slice("path", F.lit(1), F.col("i") + 2)
        group = each.groupBy(path.alias("path"), F.col("of").alias("words")).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum((F.col("n") == at + 1 + F.col("i")).cast("long")).alias("n_ends"), F.min("n").alias("n"))
        level = written(group.withColumn("depth", (F.lit(at - 1) + F.size("path")).cast("long")), "level")
        alone = level.where("n_convs = 1").groupBy("conv_id", "n").agg(F.min("depth").alias("depth"), F.min_by("path", "depth").alias("path"))
        levels.append(level.where("n_convs > 1"))
        retired.append(alone)
        stay = moves.join(level.where("n_convs = 1").select("conv_id"), "conv_id", "left_anti")
        at += size
        stay = written(stay.select("conv_id", "n", F.element_at("path", -1).alias("cls"), *(F.when(F.col("n") > at, F.col(c)).alias(c) for c in ("keys", "words"))), "classes")
        ends.append(stay.where(F.col("n") <= at).select("cls", "conv_id"))
        state = stay.where(F.col("n") > at)
        if at % CHUNK == 0:
            state = state.drop("keys", "words").join(chunks.where(F.col("chunk") == at // CHUNK).select("conv_id", "keys", "words"), "conv_id")
    return levels, retired, _union(ends)


def _folded(levels: list[DataFrame], retired: list[DataFrame]) -> list[DataFrame]:
    """(cls, n_leaves, saved_tokens) over the subtrees of all classes with several members, and of the root: each step hands its own nodes' sums, and what the step below handed up, to the ancestors within the step."""
    out, below = [], None
    for level, alone in zip(reversed(levels), reversed(retired), strict=True):
        own = level.select(F.element_at("path", -1).alias("cls"), "path", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
        if below is not None:
            own = own.unionByName(below.withColumn("path", F.lit(None).cast("array<binary>"))).groupBy("cls").agg(F.max("path").alias("path"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        leaf = alone.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        handed = own.drop("cls").unionByName(leaf).select(F.posexplode("path").alias("i", "cls"), "n_leaves", "saved_tokens")
        sums = written(handed.groupBy("cls", (F.col("i") == 0).alias("up")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "fold")
        out.append(sums.where("not up").drop("up"))
        below = sums.where("up").drop("up")
    return out if below is None else [*out, below]


def nodes(conversations: DataFrame, block: int = 20, mod: int = 4) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chunks = written(rebuilt(conversations, block, mod), "chunks")
    levels, retired, ends = _refined(chunks)
    long, none = (lambda c: F.lit(c).cast("long")), F.lit(None)
    every = chunks.where("chunk = 0")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("cls"), long(0).alias("depth"), none.cast("binary").alias("parent"), "conv_id", "n_convs")
    shared = [x.select(F.element_at("path", -1).alias("cls"), "depth", F.element_at("path", -2).alias("parent"), "conv_id", "n_convs") for x in levels]
    single = [x.select("conv_id", "n", "depth", F.element_at("path", -2).alias("parent")) for x in retired]
    facts = [
        _union([root, *shared]),
        *(x.select(F.col("parent").alias("cls"), long(1).alias("n_children")) for x in [*shared, *single]),
        *_folded(levels, retired),
        _end_digests(ends),
    ]
    columns = {"depth": "long", "parent": "binary", "conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
    wide = _union([f.select("cls", *(F.col(c) if c in f.columns else none.cast(t).alias(c) for c, t in columns.items())) for f in facts])
    total = {"n_children", "n_leaves", "saved_tokens"}
    several = wide.groupBy("cls").agg(*((F.coalesce(F.sum(c), long(0)) if c in total else F.max(c)).alias(c) for c in columns))
    several = several.withColumn("n_leaves", F.greatest("n_leaves", long(1))).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    several = written(several, "nodes")

    own = several.where("parent is not null").select(*columns)
    chains = _union(single) if single else None
    if chains is not None:
        begun = chains.select("parent", "depth", "conv_id", long(1).alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"))
        own = own.unionByName(begun)
    bound = max(1, -(-(several.agg(F.sum("n_children")).first()[0] or 0) // HOT))
    parents = several.select(F.col("cls").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > bound).drop("n_children"))
    rest = parents.where(F.col("n_children") <= bound).drop("n_children")
    placed = own.join(hot, "parent").unionByName(own.join(hot.select("parent"), "parent", "left_anti").join(rest, "parent"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = several.where("parent is null").withColumn("parent_conv_id", none.cast("long")).select(shown).unionByName(placed.select(shown))
    if chains is None:
        return out
    runs = chains.where("depth < n").select("conv_id", "n", F.explode(F.sequence(F.col("depth") + 1, F.col("n"), long(_RUN))).alias("from"))
    tail = runs.select("conv_id", "n", F.explode(F.sequence("from", F.least("n", F.col("from") + _RUN - 1))).alias("depth"))
    last = F.col("depth") == F.col("n")
    tail = tail.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), long(1).alias("n_convs"), (~last).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"))
    return out.unionByName(tail)
