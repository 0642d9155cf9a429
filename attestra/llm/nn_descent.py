"""Embedding near-duplicates by NN-descent.

Vectors of one label form a neighbour graph. It starts from the leaves of a few
random-hyperplane trees and is refined: each node gathers its neighbours and some
reverse neighbours, compares them with each other, and every list keeps its best.
A list that is full of links (cosine at or over the threshold) may hide more, so
it becomes GROW times as long, once. Refinement ends when an audit (exact
neighbours of a hashed sample of each large label's vectors, found by comparing
them with every vector) shows the target recall, as the mean over nodes with
links, in every label that has links in its sample; where a round stops improving,
fresh trees join the next one. The recalls are logged by label.
What is left is compared exactly, in pairs of blocks: labels under the target or
without a measured recall with all their nodes, and nodes whose long list is full
as well (dense clusters). A label of n nodes costs (n / 2048)^2 / 2 messages of
about 1.5 MB there: 120 for 32,000 nodes, 2.4e9 / 2 for 10^8, which is out of reach;
a label of that size has to pass its audit.
Links are the edges at or over the threshold, in double precision.

Equal vectors under one label are one node from the start.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those without label, link with nothing and are their own
component; vectors of different lengths link with nothing; a repeated vec_id
counts for each row, and rows of one vec_id with different vectors are different nodes;
a null vec_id stays null and is no one's component_id (rows linked to none but such rows have
none, and are kept); other input columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import dealt, written
from attestra.llm.components import components

_LOG = logging.getLogger(__name__)
GROW = 8
_TASK_ROWS = 20_000
_BLOCK = 2048
_STALLED = 0.002
_LIST = "rep long, nbr binary, sim binary"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, bytes of the vector (null where it can't link)."""
    for batch in batches:
        col = batch.column("embedding")
        double = pa.types.is_float64(col.type.value_type)
        out = []
        for x, label in zip(col, batch.column("label").to_pylist(), strict=True):
            v = x.values if x.is_valid and label is not None else None
            if v is None or v.null_count or not len(v):
                out.append(None)
                continue
            v = v.to_numpy(zero_copy_only=False).astype(np.float64 if double else np.float32)
            out.append((v + 0.0).tobytes() if np.isfinite(v).all() and v.any() else None)  # -0 becomes 0
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])


def _unit(blobs: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(trees: int, leaf: int, dtype, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            blobs, n, group = batch.column("v").to_pylist(), batch.column("n").to_numpy(), batch.column("g").to_numpy()
            size = np.array([len(b) for b in blobs])
            leaves = np.zeros((len(blobs), trees), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x = _unit([blobs[i] for i in at], dtype)
                if s not in planes:
                    planes[s] = np.random.default_rng(seed).standard_normal((trees * 48, x.shape[1]))
                bits = (x @ planes[s].T > 0).reshape(len(at), trees, 48)
                depth = np.clip(np.ceil(np.log2(np.maximum(n[at] / leaf, 1))), 0, 48)
                code = (bits * (np.arange(48) < depth[:, None])[:, None, :] * (1 << np.arange(48))).sum(2).astype(np.uint64)
                key = T.mix(code + T.mix(group[at].astype(np.uint64)[:, None] * np.uint64(2 * trees + 1) + np.arange(trees, dtype=np.uint64)))
                leaves[at] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "g", "w", "v")), pa.array(leaves.tolist(), pa.list_(pa.int64()))], names=["rep", "g", "w", "v", "leaves"])

    return run


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest in each row."""
    if sim.shape[1] > k:
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return at, np.take_along_axis(sim, at, 1)
    return np.broadcast_to(np.arange(sim.shape[1]), sim.shape), sim


def _compare(dtype):
    """Members of each hub against each other: for every member its best others."""

    def run(key, table):
        hub, rep, k = (table.column(c).to_numpy() for c in ("hub", "rep", "k"))
        order = np.lexsort((rep, hub))
        hub, rep, k = hub[order], rep[order], k[order]
        blobs = table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v")
        blobs = blobs.take(pa.array(order)).to_pylist()
        cut = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]])
        found: dict[int, list] = {}
        for a, b in zip(cut, [*cut[1:], len(hub)], strict=True):
            if b - a < 2:
                continue
            x = _unit(blobs[a:b], dtype)
            for i in range(a, b, 512):
                j = min(i + 512, b)
                sim = x[i - a : j - a] @ x.T
                sim[np.arange(j - i), np.arange(i - a, j - a)] = -2
                at, value = _best(sim, int(k[i:j].max()))
                for row in range(j - i):
                    found.setdefault(int(rep[i + row]), []).append((rep[a + at[row]], value[row]))
        rows = []
        most = dict(zip(rep.tolist(), k.tolist(), strict=True))
        for r, parts in found.items():
            nbr, sim = _merged(parts, most[r], r)
            rows.append((r, nbr.tobytes(), sim.tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"rep": pa.array(cols[0], pa.int64()), "nbr": pa.array(cols[1], pa.binary()), "sim": pa.array(cols[2], pa.binary())})

    return run


def _merged(parts: list, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of several lists, each neighbour once; ties by smaller id."""
    nbr, sim = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    nbr, at = np.unique(nbr, return_index=True)
    sim = sim[at]
    good = (nbr != own) & (sim > -1.5)
    nbr, sim = nbr[good], sim[good]
    at = np.lexsort((nbr, -sim))[:k]
    return np.ascontiguousarray(nbr[at]), np.ascontiguousarray(sim[at])


def _improve(threshold: float, most: int):
    """New lists of nodes: the best of the old one and the candidates; a list full of links grows."""

    def run(left, right):
        more: dict[int, list] = {}
        for r, n, s in zip(*(right.column(c).to_pylist() for c in ("rep", "nbr", "sim")), strict=True):
            more.setdefault(r, []).append((np.frombuffer(n, np.int64), np.frombuffer(s, np.float64)))
        out = {c: [] for c in ("nbr", "sim", "k", "full", "changed")}
        for r, k, n, s in zip(*(left.column(c).to_pylist() for c in ("rep", "k", "nbr", "sim")), strict=True):
            old = np.frombuffer(n or b"", np.int64)
            nbr, sim = _merged([(old, np.frombuffer(s or b"", np.float64)), *more.get(r, [])], k, r)
            full = k < most and len(nbr) >= k and bool(sim[-1] >= threshold)
            for c, v in zip(out, (nbr.tobytes(), sim.tobytes(), k * GROW if full else k, full, len(np.setdiff1d(nbr, old))), strict=True):
                out[c].append(v)
        types = {"nbr": pa.binary(), "sim": pa.binary(), "k": pa.int32(), "full": pa.bool_(), "changed": pa.int64()}
        return pa.table({"rep": left.column("rep"), "g": left.column("g"), "w": left.column("w"), "v": left.column("v"), **{c: pa.array(x, types[c]) for c, x in out.items()}})

    return run


_STATE = "rep long, g long, w long, v binary, nbr binary, sim binary, k int, full boolean, changed long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, member) of every node: itself, its neighbours, and a sample of those that have it as a neighbour."""
    for batch in batches:
        hub, member = [], []
        for r, k, n, back in zip(*(batch.column(c).to_pylist() for c in ("rep", "k", "nbr", "back")), strict=True):
            m = np.unique(np.r_[r, np.frombuffer(n or b"", np.int64), np.array(back or [], np.int64)[:k]])
            hub.append(np.full(len(m), r))
            member.append(m)
        if hub:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hub)), pa.array(np.concatenate(member).astype(np.int64))], names=["hub", "rep"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.frombuffer(b or b"", np.int64) for b in batch.column("nbr").to_pylist()]
        s = [np.frombuffer(b or b"", np.float64) for b in batch.column("sim").to_pylist()]
        a = np.repeat(batch.column("rep").to_numpy(), [len(x) for x in n])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(n)), pa.array(np.concatenate(s))], names=["a", "b", "sim"])


def _held(threshold: float):
    """Each node with the number of links in its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [int((np.frombuffer(b or b"", np.float64) >= threshold).sum()) for b in batch.column("sim").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "g", "w", "v")), pa.array(held, pa.int64())], names=["rep", "g", "w", "v", "held"])

    return run


_HELD = "rep long, g long, w long, v binary, held long"


def audit_recall(state: DataFrame, dtype, threshold: float, dense: int, sample: int = 2048, least: int = 32) -> dict[int, list[float]]:
    """By label, for each node with links of a hashed sample: the share of them in its list. The sample has at least ``least`` nodes of each of the largest labels, ``sample`` in all; it meets every node, in blocks; dense nodes are compared exactly later."""
    largest = [r["g"] for r in state.groupBy("g").count().orderBy(F.desc("count"), "g").limit(sample // least).collect()]
    held = state.where(F.col("g").isin(largest)).select("rep", "g", "w", "v", "sim").mapInArrow(_held(threshold), _HELD)
    turn = F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("rep", F.lit(7)), "rep"))
    chosen = held.withColumn("turn", turn).where(F.col("turn") <= sample // max(1, len(largest))).select("rep", "g", "v", "held").collect()
    queries = state.sparkSession.sparkContext.broadcast([(r["rep"], r["g"], bytes(r["v"])) for r in chosen if r["held"] < dense])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        for rep, g, v in queries.value:
            groups.setdefault((g, len(v)), []).append((rep, v))
        ready = {k: (np.array([r for r, _ in q]), _unit([v for _, v in q], dtype)) for k, q in groups.items()}
        total: dict[int, int] = {}
        for batch in batches:
            rep, g, blobs = batch.column("rep").to_numpy(), batch.column("g").to_numpy(), batch.column("v").to_pylist()
            size = np.array([len(b) for b in blobs])
            for (label, length), (names, q) in ready.items():
                at = np.flatnonzero((g == label) & (size == length))
                if len(at):
                    near = (_unit([blobs[i] for i in at], dtype) @ q.T >= threshold) & (rep[at][:, None] != names[None, :])
                    for r, n in zip(names.tolist(), near.sum(0).tolist(), strict=True):
                        if n:
                            total[r] = total.get(r, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["rep", "n"])

    real = {r["rep"]: r["n"] for r in state.select("rep", "g", "v").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    out: dict[int, list[float]] = {}
    for r in chosen:
        if r["held"] >= dense:
            out.setdefault(r["g"], []).append(1.0)
        elif n := real.get(r["rep"]):
            out.setdefault(r["g"], []).append(min(1.0, r["held"] / n))
    return out


def _block(key, table):
    """Nodes of one block in one row."""
    blobs = [bytes(b) for b in table.column("v").to_pylist()]
    parts = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "w", "exact")]
    return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("rep", "w", "exact", "v"), (*parts, b"".join(blobs)), strict=True)}})


def _between(threshold: float, dtype):
    """Links of a block's exact nodes with another block: the weight of each one's links, links of the other nodes, and each linked node with the smallest id it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, w, exact = (np.frombuffer(row[c], np.int64) for c in ("rep", "other", "other_w", "other_exact"))
                x, y = (_unit([v[i * (len(v) // n) : (i + 1) * (len(v) // n)] for i in range(n)], dtype) for v, n in ((row["v"], len(a)), (row["other_v"], len(b))))
                near = (x @ y.T >= threshold) & (a[:, None] != b[None, :])
                i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(i):
                    continue
                near, a, b, w, exact = near[np.ix_(i, j)], a[i], b[j], w[j], exact[j]
                left, right = a, b
                while True:
                    new = np.minimum(left, np.where(near, right[None, :], np.iinfo(np.int64).max).min(1))
                    down = np.minimum(right, np.where(near, new[:, None], np.iinfo(np.int64).max).min(0))
                    if (new == left).all() and (down == right).all():
                        break
                    left, right = new, down
                p, q = np.nonzero(near & (exact == 0)[None, :])
                found = [("count", a, a, near @ w), ("link", b[q], a[p], np.zeros(len(p), np.int64)), ("edge", np.r_[a, b], np.r_[left, right], np.zeros(len(a) + len(b), np.int64))]
                for kind, c, d, n in found:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.string()), pa.array(c), pa.array(d), pa.array(n.astype(np.int64))], names=["kind", "a", "b", "n"])

    return run


def exact_links(nodes: DataFrame, threshold: float, dtype) -> DataFrame:
    """kind, a, b, n: links of the nodes with ``exact``, found by comparing them with every node of their label, in pairs of blocks."""
    sizes = nodes.groupBy("g").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"), F.ceil(F.sum("exact") / _BLOCK).alias("lefts")).where("lefts > 0")
    nodes = nodes.join(sizes, "g")
    row = "g long, block long, rep binary, w binary, exact binary, v binary"
    cut = lambda df, n: df.select("g", F.pmod(F.xxhash64("rep"), F.col(n)).cast("long").alias("block"), "rep", "w", "exact", "v").groupBy("g", "block").applyInArrow(_block, row)
    right = written(cut(nodes, "blocks"), "blocks").select("g", "block", *(F.col(c).alias("other" if c == "rep" else f"other_{c}") for c in ("rep", "w", "exact", "v")))
    left = written(cut(nodes.where("exact = 1"), "lefts"), "exact-blocks").join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "rep", "v")
    return written(left.join(right, ["g", "block"]).mapInArrow(_between(threshold, dtype), "kind string, a long, b long, n long"), "exact-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = 10, trees: int = 5, leaf: int = 48, target: float = 0.995, least_rounds: int = 2, most_rounds: int = 12) -> tuple[DataFrame, list[float]]:
    """(rows, recall seen by the audits). Rows: vec_id, n_links, component_id, kept."""
    double = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    dtype = np.float64 if double else np.float32
    vec = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    rows = written(vec.mapInArrow(_nodes, "vec_id long, label long, v binary"), "vectors")
    valid = rows.where("v is not null").withColumn("g", F.xxhash64("label", F.length("v")))
    nodes = valid.groupBy("g", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    nodes = written(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")  # a number of its own, fixed once written
    n_nodes = nodes.count()
    tasks = max(24, n_nodes * 3 * k // _TASK_ROWS)
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n"))
    with_sizes = nodes.join(sizes, "g").select("rep", "g", "w", "v", "n")

    def leaves_of(seed: int) -> DataFrame:
        start = written(with_sizes.mapInArrow(_leaves(trees, leaf, dtype, seed), "rep long, g long, w long, v binary, leaves array<long>"), "leaves")
        # a leaf that many vectors share (a dense cluster) is cut at random; refinement brings its parts together
        placed = start.select("rep", "v", F.explode("leaves").alias("hub"))
        big = placed.groupBy("hub").count().where(F.col("count") > 2 * leaf)
        return placed.join(big, "hub", "left").withColumn("hub", F.when(F.col("count").isNull(), F.col("hub")).otherwise(F.xxhash64("hub", F.pmod(F.xxhash64("rep", "hub"), F.ceil(F.col("count") / leaf)))))

    placed = leaves_of(13)
    compare, improve = _compare(dtype), _improve(threshold, GROW * k)

    def refine(state: DataFrame, placed: DataFrame) -> DataFrame:
        task = F.pmod(F.xxhash64("hub"), F.lit(tasks))
        found = dealt(placed.select(task.alias("task"), "hub", "rep", "v", "k"), tasks, "task").groupBy("task").applyInArrow(compare, _LIST)
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(tasks)).alias("part")
        left = state.select(part("rep"), *(c.split()[0] for c in _STATE.split(", ")))
        right = found.select(part("rep"), "rep", "nbr", "sim")
        return written(dealt(left, tasks, "part").groupBy("part").cogroup(dealt(right, tasks, "part").groupBy("part")).applyInArrow(improve, _STATE), "graph")

    blank = [F.lit(None).cast("binary").alias("nbr"), F.lit(None).cast("binary").alias("sim"), F.lit(k).cast("int").alias("k"), F.lit(False).alias("full"), F.lit(0).cast("long").alias("changed")]
    state = refine(nodes.select("rep", "g", "w", "v", *blank), placed.withColumn("k", F.lit(k).cast("int")))
    recalls: list[float] = []
    good, seen, fresh, stalled = [], {}, 0, False
    for turn in range(most_rounds):
        edges = state.select("rep", "nbr", "sim").mapInArrow(_edges, "a long, b long, sim double")
        # reverse neighbours: a hashed sample of at most 256, however many there are
        one = edges.groupBy(F.col("b").alias("rep"), F.pmod(F.xxhash64("a"), F.lit(256)).alias("salt")).agg(F.min(F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), "a")).alias("x"))
        back = one.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["a"]).alias("back"))
        placed = state.select("rep", "k", "nbr").join(back, "rep", "left").mapInArrow(_members, "hub long, rep long")
        if stalled:
            placed = placed.unionByName(leaves_of(13 + fresh).select("hub", "rep"))
        state = refine(state, placed.join(state.select("rep", "v", "k"), "rep"))
        full = state.where("full").limit(1).count()
        if turn + 1 >= least_rounds and not full:
            seen = audit_recall(state, dtype, threshold, GROW * k)
            shares = [x for part in seen.values() for x in part]
            recalls.append(float(np.mean(shares)) if shares else 1.0)
            good = [g for g, part in seen.items() if np.mean(part) >= target]
            met = len(good) == len(seen)
            stalled = len(recalls) > 1 and recalls[-1] - recalls[-2] < _STALLED
            if met or stalled and fresh == 2:
                break
            fresh += stalled
    recall_of = {g: float(np.mean(part)) for g, part in seen.items()}
    _LOG.info("recall by label (those left out are compared exactly): %s", {g: recall_of[g] for g in good})
    poor = ~F.col("g").isin(good)  # too low, or not measured: too small for the audit, or without links in its sample
    exact = state.select("rep", "g", "w", "v", "sim").mapInArrow(_held(threshold), _HELD).withColumn("exact", (poor | (F.col("held") >= GROW * k)).cast("long")).drop("held")
    exact = written(exact, "exact")
    more = exact_links(exact, threshold, dtype)
    # lists of nodes compared exactly say nothing new: their counts and spanning edges come from the blocks
    short = state.select("rep", "nbr", "sim").join(exact.where("exact = 0").select("rep"), "rep", "left_semi")
    link = short.mapInArrow(_edges, "a long, b long, sim double").where(F.col("sim") >= threshold).select("a", "b").unionByName(more.where("kind = 'link'").select("a", "b"))
    link = written(link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    weight = nodes.select(F.col("rep").alias("b"), "w")
    links = link.join(weight, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("links"))
    counted = more.where("kind = 'count'").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    links = exact.select("rep", "exact").join(links, "rep", "left").join(counted, "rep", "left").select("rep", F.when(F.col("exact") == 1, F.col("n")).otherwise(F.col("links")).alias("links"))
    group = components(link.unionByName(more.where("kind = 'edge'").select("a", "b"))).withColumnRenamed("id", "rep")
    group = written(group.join(nodes.select("rep", "least"), "rep"), "groups")
    heads = group.groupBy("component").agg(F.min("least").alias("head"))
    node = nodes.join(links, "rep", "left").join(group.select("rep", "component").join(heads, "component"), "rep", "left")
    node = node.select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("head")).alias("component_id"))
    out = rows.withColumn("g", F.xxhash64("label", F.length("v"))).join(node, ["g", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), recalls
