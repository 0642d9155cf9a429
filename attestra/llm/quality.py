"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become hashed counts of words, word shapes and neighbouring shapes; document
frequencies are counted over all documents. A bounded sample of labelled rows
(``sample`` rows, chosen by hash of doc_id) gives the latent space (truncated SVD)
and the labelled vectors, which are broadcast: sample x rank floats, whatever the
input's size. Every document is compared with all of them in blocks, and the
``k`` nearest vote with their labels, weighted by cosine.

Defined cases: null text is empty; a text without words (a zero vector) gets the
mean of all labels learnt from, sampled or not; labels that are null, not 0 or 1, or contradict each other are not
learnt from; of several texts under a labelled doc_id the smallest is learnt from; with no labels at all every score is 0.5; ties among neighbours
(cosines equal to six places) go to the smaller doc_id; repeated rows give repeated results; labels, lang, source
and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T

FEATURES = 1 << 13
#: Text bytes whose features a task holds at once; documents whose cosines it holds at once.
_SLICE, _ROWS = 1 << 20, 128
RANK = 64
_SCHEMA = "doc_id long, at binary, count binary"


def _classes() -> np.ndarray:
    """Byte classes for word shapes: lower, upper, digit, letters beyond ASCII, and every other byte itself."""
    c = np.arange(256, dtype=np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:] = 97, 65, 48, 97
    return c


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of hashed words, shapes, shape pairs, immediate repeats and the share of distinct words; sorted."""
    start, end, of = T.words(buf, off)
    word = T.word_hashes(T.lower_ascii(buf), start, end, 1)[0]
    cls = _classes()[buf]
    n = end - start
    # a shape: first, last and next-to-last class, length up to 12, and the sum of the classes present
    inner = np.where(n > 1, cls[np.minimum(start + 1, len(cls) - 1)] if len(cls) else 0, 0)
    shape = (cls[start].astype(np.uint64) << np.uint64(24)) | (inner.astype(np.uint64) << np.uint64(16)) | (cls[end - 1].astype(np.uint64) << np.uint64(8)) | np.minimum(n // 3, 4).astype(np.uint64) if len(n) else np.zeros(0, np.uint64)
    kind = lambda h, k: (T.mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(FEATURES)).astype(np.int64)
    same = of[1:] == of[:-1]
    rows = [(of, kind(word, 1)), (of, kind(shape, 2)), (of[1:][same], kind(shape[1:] * np.uint64(31) + shape[:-1], 3)[same])]
    rep = same & (word[1:] == word[:-1])
    rows.append((of[1:][rep], np.full(int(rep.sum()), kind(np.array([7], np.uint64), 4)[0])))
    # how much a text repeats itself: one feature for its share of distinct words, as often as it has words
    total = np.bincount(of, minlength=len(off) - 1)
    order = np.lexsort((word, of))
    fresh = np.ones(len(of), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
    share = np.bincount(of[order][fresh], minlength=len(total)) * 8 // np.maximum(total, 1)
    long = np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64) // 2, 4)
    rows.append((of, kind((share * 8 + long).astype(np.uint64), 5)[of]))
    key, count = np.unique(np.concatenate([d * FEATURES + f for d, f in rows]), return_counts=True)
    return key // FEATURES, key % FEATURES, count


def weighted(doc: np.ndarray, at: np.ndarray, count: np.ndarray, idf: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Unit latent vectors of n documents (zero where there is nothing)."""
    v = (1 + np.log(count)).astype(np.float32) * idf[at]
    out = np.zeros((n, basis.shape[1]), np.float32)
    for a in range(0, len(doc), 1 << 16):
        d = doc[a : a + (1 << 16)]
        part = v[a : a + (1 << 16), None] * basis[at[a : a + (1 << 16)]]
        head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        np.add.at(out, d[head], np.add.reduceat(part, head, axis=0))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature over all documents: partial counts in each task, summed in Spark; FEATURES rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for piece in T.slices(batches, "text", _SLICE):
            total += np.bincount(features(*T.strings(piece.column("text")))[1], minlength=FEATURES)
            n += piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.r_[total, n])], names=["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        df[r["at"]] = r["n"]
    return df[:-1], int(df[-1])


def _svd(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular directions of x by subspace iteration (features x rank)."""
    rank = max(1, min(rank, *x.shape))
    q = np.linalg.qr(x.T @ np.random.default_rng(5).standard_normal((x.shape[0], min(rank + 16, *x.shape)), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, label: str, sample: int, rank: int) -> tuple:
    """(idf, basis, labelled vectors, their labels, mean label), of bounded size; the vectors are in order of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").where(~held_out)
    # half of each label where there is enough of both, so that a rare label is not lost in a bounded sample
    parts = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "y")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text", _SLICE):
            doc, at, count = features(*T.strings(piece.column("text")))
            cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            cols = [[x[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in (at, count)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["doc_id", "y", "at", "count"])

    # one text for each chosen doc_id, so at most `sample` rows
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    learnt = one.select("doc_id", "text", "y").mapInArrow(sparse, "doc_id long, y int, at binary, count binary").collect()
    learnt = sorted(learnt, key=lambda r: (r["doc_id"], r["at"], r["count"]))
    df, n_docs = _document_frequencies(docs)
    idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32) + 1
    ys = np.array([r["y"] for r in learnt], np.float32)
    mean = y.agg(F.avg("y")).first()[0]  # of all labels, not of the halved sample
    mean = 0.5 if mean is None else float(mean)
    basis, lsa = np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32)
    if len(ys):
        at, count = ([np.frombuffer(r[c], np.int32) for r in learnt] for c in ("at", "count"))
        doc = np.repeat(np.arange(len(learnt)), [len(a) for a in at])
        at, count = np.concatenate(at).astype(np.int64), np.concatenate(count)
        x = np.zeros((len(learnt), FEATURES), np.float32)
        x[doc, at] = (1 + np.log(count)) * idf[at]
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(size > 0, size, 1)
        basis = _svd(x, rank)
        lsa = weighted(doc, at, count, idf, basis, len(learnt))
    return idf, basis, lsa, ys, mean


def _voter(docs: DataFrame, labels: DataFrame, held_out: Column, label: str, sample: int, k: int, rank: int):
    """A function from a batch with ``text`` to its scores, learnt from ``docs`` and ``labels``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out, label, sample, rank))

    def vote(piece: pa.RecordBatch) -> np.ndarray:
        idf, basis, lsa, ys, mean = model.value
        n = piece.num_rows
        out = np.full(n, mean)
        if len(ys):
            doc, at, count = features(*T.strings(piece.column("text")))
            x = weighted(doc, at, count, idf, basis, n)
            for a in range(0, n, _ROWS):
                sim = np.maximum(x[a : a + _ROWS] @ lsa.T, 0)
                m = min(k, len(ys))
                # cosines to six places, then the place among the labelled rows (by doc_id): no two keys are equal
                rank = np.arange(len(ys)) - np.rint(sim * np.float64(10**6)) * len(ys)
                near = np.sort(np.argpartition(rank, m - 1, axis=1)[:, :m], axis=1)
                w = np.take_along_axis(sim, near, 1).astype(float) ** 4
                total = w.sum(1)
                out[a : a + _ROWS] = np.where(total > 1e-9, (w * ys[near]).sum(1) / np.maximum(total, 1e-9), mean)
        return np.clip(out, 0, 1)

    return vote


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", sample: int = 3000, k: int = 25, rank: int = RANK) -> DataFrame:
    """doc_id, score: the likelihood of label 1. ``held_out`` is a condition on doc_id; such labels are not learnt from."""
    vote = _voter(docs, labels, held_out, label, sample, k, rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(vote(piece))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = 0.5, label: str = "quality", sample: int = 3000, k: int = 25, rank: int = RANK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    vote = _voter(docs, labels, held_out, label, sample, k, rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text", _SLICE):
            yield piece.filter(pa.array(vote(piece) >= least))

    return docs.mapInArrow(run, docs.schema)
