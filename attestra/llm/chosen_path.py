"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Recursively, each set picks shared
tokens by a hash of the path so far (PICKS of its tokens on average), and sets
that picked the same path form a bucket. Buckets of more than ``limit`` sets split
once more; those that still hold more than _DEEP sets are split again and again, as
long as that saves comparisons. Runs with independent hashes repeat until
a pair at the threshold is missed with probability below 1 - ``recall``, at any
depth. Every pair of a bucket is then compared exactly. Large buckets (near copies,
which no token parts) are cut into blocks, and
each pair of blocks is a task of its own; the result of a bucket is a row for each
member (its links and a spanning edge), never a row for each pair. A pair that
shares several buckets counts in the first of them only.

Texts with equal sets are one class from the start and meet as one row. Classes have
numbers of their own; doc_id is only looked up at the end.

Defined cases: words are lower-cased and parted by white space; a text of one to
four words is one shingle; null texts and texts without words link with nothing;
two texts under one doc_id are two documents; a repeated row counts as a copy in
n_links; a null doc_id stays null, is no one's class_id or copy_of (null where a class
has no other) and comes after all others when one of a class is kept; other input columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import dealt, free_names, made_up, numbered, written
from attestra.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Tokens that a node picks on average: at the root, on the second level, whose rows are fewest for a given recall with few picks, and on every one below.
PICKS = (2, 1, 5)
#: Levels below the second.
_DEPTH = 6
_BLOCK = 512
#: Sets of a bucket from which a split can cost less than comparing its blocks: the split ships each member's text and about PICKS[-1] sets, the blocks ship m / _BLOCK sets.
_DEEP = 8 * _BLOCK
_TASK_BYTES = 8 << 20
_DENSE = 8


def runs_needed(threshold: float, recall: float, picks: tuple[float, ...] = PICKS) -> int:
    """Runs after which a pair at the threshold is missed with probability below 1 - recall, even where every bucket splits on every level."""
    found = 1.0
    for n in [*[picks[-1]] * _DEPTH, *reversed(picks[:-1])]:  # a node survives if one of its shared tokens is picked and survives
        found = 1 - math.exp(-n * threshold * found)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def shingle_sets(piece: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    buf, off = T.strings(pa.array([(t or "").lower() for t in piece.column("text").to_pylist()], pa.string()))
    start, end, of = T.words(buf, off)
    w = T.word_hashes(buf, start, end, 1)[0]
    h = T.window_hashes(w, words, 0)
    cut = np.searchsorted(of, np.arange(piece.num_rows + 1))
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        else:
            out.append(T.window_hashes(w[a:b], int(b - a), 1) if b > a else np.zeros(0, np.uint64))
    return out


def _set_id(s: np.ndarray) -> tuple[int, int]:
    both = (T.mix(s).sum(dtype=np.uint64), T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return tuple(int(x.astype(np.int64)) for x in both)


def _picked(s: np.ndarray, path: np.uint64, picks: int) -> np.ndarray:
    """Hashes of the paths that continue ``path`` by a token of s."""
    h = T.mix(s ^ path)
    bound = np.uint64(min((1 << 64) - 1, (picks << 64) // len(s)))
    return T.mix(h[h <= bound] + path)


def _paths(words: int, runs: int, picks: tuple[int, ...]):
    seeds = T.mix(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text"):
            doc = piece.column("doc_id").to_numpy(zero_copy_only=False)
            own = [piece.column(c) for c in ("made", "th")]
            rows = []
            for d, s in zip(doc.tolist(), shingle_sets(piece, words), strict=True):
                if not len(s):
                    rows.append((d, d, -1, 0, [], []))
                    continue
                first = np.concatenate([_picked(s, x, picks[0]) for x in seeds])
                second = [_picked(s, x, picks[1]) for x in first]
                rows.append((d, *_set_id(s), len(s), first.view(np.int64), [x.view(np.int64) for x in second]))
            cols = list(zip(*rows, strict=True))
            paths = pa.array(cols[4], pa.list_(pa.int64()))
            more = pa.array(cols[5], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), paths, more, *own], names=["doc_id", "lo", "hi", "n", "paths", "more", "made", "th"])

    return run


def _buckets(rows: DataFrame) -> DataFrame:
    """Size and a signature of the members of every bucket of two or more."""
    return rows.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("s2")).where("m > 1")


def _tokens(words: int):
    """Each class's set, from the text of one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text", 1 << 20):
            sets = shingle_sets(piece, words)
            good = [i for i, s in enumerate(sets) if len(s) and _set_id(s) == (piece.column("lo")[i].as_py(), piece.column("hi")[i].as_py())]
            if good:
                yield pa.RecordBatch.from_arrays([piece.column("rep").take(pa.array(good)), pa.array([sets[i].tobytes() for i in good], pa.binary()), piece.column("parents").take(pa.array(good))], names=["rep", "tokens", "parents"])

    return run


def _split(picks: int):
    """The buckets below a set's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, tokens, parents in zip(*(batch.column(c).to_pylist() for c in ("rep", "tokens", "parents")), strict=True):
                s = np.frombuffer(tokens, np.uint64)
                for path in np.array(parents, np.int64):
                    rows += [(rep, int(path), x) for x in _picked(s, path.view(np.uint64), picks).view(np.int64).tolist()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "parent", "bucket"])

    return run


def _below(docs: DataFrame, classes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """rep, parent, bucket: the buckets one level below those of ``rows`` (rep, bucket)."""
    parents = rows.groupBy("rep").agg(F.collect_set("bucket").alias("parents")).join(classes.select("rep", F.col("first.doc_id").alias("src"), "lo", "hi"), "rep")
    sets = docs.join(parents, docs["doc_id"] == parents["src"]).select("rep", "lo", "hi", "text", "parents").mapInArrow(_tokens(words), "rep long, tokens binary, parents array<long>")
    return written(sets.mapInArrow(_split(PICKS[-1]), "rep long, parent long, bucket long").distinct(), "deep")


def _deeper(docs: DataFrame, classes: DataFrame, rows: DataFrame, sizes: DataFrame, words: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows, sizes) of the buckets that take the place of those over _DEEP sets.

    A hashed sample of about _BLOCK members tells whether a split would save
    comparisons; only then are all members split, level by level. The other buckets
    stay whole. The sample decides on cost alone: every bucket is compared exactly.
    """
    sizes = sizes.where(F.col("m") > _DEEP)
    done: list[DataFrame] = []
    of_done: list[DataFrame] = []
    for _ in range(_DEPTH):
        if not sizes.limit(1).count():
            return done, of_done
        big = sizes.select(F.col("bucket").alias("parent"), "m")
        few = F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.col("m") / _BLOCK)) == 0
        sample = written(rows.join(big, (F.col("bucket") == F.col("parent")) & few).select("rep", "bucket"), "deep")
        n = sample.groupBy(F.col("bucket").alias("parent")).agg(F.count("*").alias("n"))
        shares = _below(docs, classes, sample, words).groupBy("parent", "bucket").agg(F.count("*").alias("c")).groupBy("parent").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("work"))
        cut = written(n.join(shares, "parent", "left").where(F.coalesce("work", F.lit(0.0)) < 2.0 * F.col("n") * F.col("n")).select("parent"), "judged")
        of_done.append(sizes.join(cut.withColumnRenamed("parent", "bucket"), "bucket", "left_anti"))  # their rows are in the level above
        if not cut.limit(1).count():
            return done, of_done
        below = _below(docs, classes, rows.join(cut.withColumnRenamed("parent", "bucket"), "bucket", "left_semi"), words)
        rows = below.select("rep", "bucket")
        level = written(_buckets(rows), "buckets")
        done.append(rows)
        of_done.append(level.where(F.col("m") <= _DEEP))
        sizes = level.where(F.col("m") > _DEEP)
    return done, [*of_done, sizes]  # the last level is compared whole


def _members(words: int):
    schema = pa.schema([("task", pa.int64()), ("bucket", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("own", pa.int32()), ("rep", pa.int64()), ("w", pa.int64()), ("all", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text", 1 << 20):
            sets = shingle_sets(piece, words)
            rows: list[tuple] = []
            size = 0
            for i, s in enumerate(sets):
                rep, lo, hi, w, places = (piece.column(c)[i].as_py() for c in ("rep", "lo", "hi", "w", "places"))
                if not len(s) or _set_id(s) != (lo, hi):
                    continue  # another text under the same doc_id
                tokens = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()  # 48 bits of each
                every = np.unique(np.array([p["bucket"] for p in places], np.int64)).tobytes()
                for p in places:
                    rows.append((p["task"], p["bucket"], p["bi"], p["bj"], p["own"], rep, w, every, tokens))
                    size += len(tokens)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    df = np.diff(np.r_[head, len(token)])
    exact = np.float32 if max(map(len, sets), default=0) < 1 << 24 else np.float64
    out = np.zeros((m, m), exact)
    for d in range(2, _DENSE + 1):  # rare tokens: their few pairs one by one
        at = head[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(out, (who[at + i], who[at + j]), 1)
                np.add.at(out, (who[at + j], who[at + i]), 1)
    often = np.flatnonzero(df > _DENSE)
    for a in range(0, len(often), 4096):  # others: products of incidence blocks
        part = often[a : a + 4096]
        dense = np.zeros((m, len(part)), exact)
        for c, k in enumerate(part):
            dense[who[head[k] : head[k] + df[k]], c] = 1
        out += dense @ dense.T
    return out


def _compare(threshold: float):
    def run(key, table):
        order = np.lexsort([table.column(c).to_numpy() for c in ("rep", "bj", "bi", "bucket")])
        cols = {c: table.column(c).to_numpy()[order] for c in ("bucket", "bi", "bj", "own", "rep", "w")}
        every, tokens = ([table.column(c)[int(i)].as_py() for i in order] for c in ("all", "tokens"))
        group = np.stack([cols["bucket"], cols["bi"], cols["bj"]])
        cut = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)])
        reps, links, roots = [], [], []
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            rep, at = np.unique(cols["rep"][a:b], return_index=True)
            at = at + a
            sets = []
            for i in at:
                raw = np.zeros((len(tokens[i]) // 6, 8), np.uint8)
                raw[:, :6] = np.frombuffer(tokens[i], np.uint8).reshape(-1, 6)
                sets.append(raw.view(np.uint64).ravel())
            n = np.array([len(s) for s in sets], np.float64)
            common = common_tokens(sets).astype(np.float64)
            near = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
            if cols["bi"][a] != cols["bj"][a]:  # pairs across two blocks only
                own = cols["own"][at]
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            # not the pairs that meet in an earlier bucket
            mine = [np.frombuffer(every[i], np.int64) for i in at]
            earlier, where = np.unique(np.concatenate(mine), return_inverse=True)
            seen = np.zeros((len(at), len(earlier)), np.float32)
            seen[np.repeat(np.arange(len(at)), [len(x) for x in mine]), where] = 1
            seen = seen[:, earlier < cols["bucket"][a]]
            if seen.shape[1]:
                near &= (seen @ seen.T) == 0
            w = cols["w"][at]
            count = near @ w.astype(np.float64)
            root = np.arange(len(at))
            while True:  # smallest member reachable inside this bucket
                new = np.minimum(root, np.where(near, root[None, :], len(at)).min(1))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(near.any(1))
            reps.append(rep[some]), links.append(count[some]), roots.append(rep[root[some]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0)
        return pa.table({"rep": pa.array(cat(reps).astype(np.int64)), "links": pa.array(np.rint(cat(links)).astype(np.int64)), "root": pa.array(cat(roots).astype(np.int64))})

    return run


def _joined(docs: DataFrame, words: int, threshold: float, recall: float, limit: int) -> DataFrame:
    """doc_id (numbered), made, th (hash of the text), copy_of, n_links, class_id, and whether the row is the first of its class."""
    runs = runs_needed(threshold, recall)
    text = F.col("text").cast("string")
    docs = docs.select(numbered(docs).alias("doc_id"), made_up().alias("made"), F.xxhash64(text).alias("th"), text.alias("text"))
    sets = written(docs.mapInArrow(_paths(words, runs, PICKS), "doc_id long, lo long, hi long, n long, paths array<long>, more array<array<long>>, made boolean, th long"), "sets")
    docs = docs.select("doc_id", "text")
    real = F.min(F.when(~F.col("made"), F.col("doc_id")))
    classes = sets.groupBy("lo", "hi").agg(F.min(F.struct("made", "doc_id", "th")).alias("first"), real.alias("least"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("more").alias("more"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a number of its own, fixed once written

    one = classes.select("rep", F.explode(F.arrays_zip("paths", "more")).alias("p")).select("rep", F.col("p.paths").alias("bucket"), F.col("p.more").alias("more"))
    sizes1 = written(_buckets(one), "buckets")
    # buckets over the limit split on a second token
    two = written(one.join(sizes1.where(F.col("m") > limit).select("bucket"), "bucket", "left_semi").select("rep", F.explode("more").alias("bucket")), "second")
    sizes2 = written(_buckets(two), "buckets")
    below, of_below = _deeper(docs, classes, two, sizes2, words)
    # of buckets with the same members one is enough
    sizes = functools.reduce(DataFrame.unionByName, of_below, sizes1.where(F.col("m") <= limit).unionByName(sizes2.where(F.col("m") <= _DEEP)))
    kept = written(sizes.groupBy("m", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets")
    total = kept.agg(F.sum(F.col("m") * F.ceil(F.col("m") / _BLOCK))).first()[0] or 0
    mean = classes.agg(F.avg("n")).first()[0] or 0
    tasks = max(64, int(total * (mean * 6 + 200) // _TASK_BYTES))

    member = functools.reduce(DataFrame.unionByName, below, one.select("rep", "bucket").unionByName(two)).join(kept, "bucket").distinct()
    blocks = F.ceil(F.col("m") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")
    places = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    places = places.select("rep", "bucket", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    places = places.withColumn("task", F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(tasks)))
    places = places.groupBy("rep").agg(F.collect_list(F.struct("task", "bucket", "bi", "bj", "own")).alias("places"))
    places = places.join(classes.select("rep", F.col("first.doc_id").alias("src"), "lo", "hi", "w"), "rep")
    located = docs.join(places, docs["doc_id"] == places["src"]).drop("doc_id", "src")
    members = located.mapInArrow(_members(words), "task long, bucket long, bi int, bj int, own int, rep long, w long, all binary, tokens binary")
    found = written(dealt(members, tasks, "task").groupBy("task").applyInArrow(_compare(threshold), "rep long, links long, root long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep").join(classes.select("rep", "least", "first"), "rep")
    group = written(group, "groups")
    heads = group.groupBy("component").agg(F.min("least").alias("g_least"), F.min("first").alias("g_first"))
    of_class = classes.select("lo", "hi", "rep", "w", "n", "least", "first").join(links, "rep", "left").join(group.select("rep", "component").join(heads, "component"), "rep", "left")
    n_links = F.when(F.col("n") == 0, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("w") - 1).cast("long")
    linked = F.col("component").isNotNull()
    of_class = of_class.select("lo", "hi", F.col("least").alias("copy_of"), n_links.alias("n_links"), F.when(linked, F.col("g_least")).otherwise(F.col("least")).alias("class_id"), F.when(linked, F.col("g_first")).otherwise(F.col("first")).alias("head"))
    out = sets.select("doc_id", "made", "th", "lo", "hi").join(of_class, ["lo", "hi"])
    return out.select("doc_id", "made", "th", "copy_of", "n_links", "class_id", (F.struct("made", "doc_id", "th") == F.col("head")).alias("kept"))


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = 0.999, limit: int = 64) -> DataFrame:
    """One row per document: doc_id, copy_of (smallest doc_id with an equal set), n_links (documents at or over the threshold), class_id (smallest doc_id reachable by links), kept (the first document of its class)."""
    out = _joined(docs, words, threshold, recall, limit)
    return out.select(F.when(~F.col("made"), F.col("doc_id")).alias("doc_id"), "copy_of", "n_links", "class_id", "kept")


def deduplicated(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = 0.999, limit: int = 64) -> DataFrame:
    """The rows of ``docs``, with all their columns: of each class the one with the smallest doc_id (null last; of two texts under it the one with the smaller hash); of equal rows one."""
    number, text_hash = free_names(docs, 2)
    keep = _joined(docs, words, threshold, recall, limit).where("kept").select(F.col("doc_id").alias(number), F.col("th").alias(text_hash)).distinct()
    keyed = docs.withColumn(number, numbered(docs)).withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(keep, [number, text_hash], "left_semi").dropDuplicates([number, text_hash]).drop(number, text_hash)
