"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each window of ``k`` consecutive words is hashed. Windows are dealt to buckets by
hash, packed in arrays, so that the exchange costs about a dozen bytes a window;
a window that repeats inside one slice of a task travels once. A bucket compares
the hashes that it holds and reports every window that is not the first of its
kind, in (doc_id, start) order. Reports are dealt back by document, repeated
windows merge into maximal removal intervals, and those words go.

A window's key has 72 hash bits beside the bucket number, which adds bits with the input.

Defined cases: null or empty text has no words; rows without doc_id
sort after ids under 2**62 (those with equal texts count as one document); rows that
repeat a doc_id count as one document: a window that begins at the same word in
several of them is judged once, words go from each row at the places found in any of them (so
equal rows yield equal results), and each row yields its own result; input columns
other than doc_id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import dealt, made_up, numbered, text_bytes

_BUCKET_BYTES = 12 << 20  # of text, for each bucket of windows
_GROUP_BYTES = 6 << 20  # of text, for each group of documents


def _windows(k: int, buckets: int, groups: int):
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary()), ("h", pa.binary()), ("x", pa.binary())])

    def deal(kind, key, n, *cols):
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, cols = key[order], [c[order] for c in cols]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
            yield (kind, int(key[a]), *(T.pack(c[a:b]) for c in cols), *[None] * (4 - n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.slices(batches, "text"):
            piece = piece.take(pa.array(np.argsort(T.ids(piece.column("doc_id")), kind="stable")))
            doc = T.ids(piece.column("doc_id"))
            buf, off = T.strings(piece.column("text"))
            start, end, of = T.words(buf, off)
            if len(start) < k:
                continue
            a, b = T.word_hashes(buf, start, end)
            h, g = T.window_hashes(a, k, 0), T.window_hashes(b, k, 1)
            inside = of[: len(h)] == of[k - 1 :]
            first = np.searchsorted(of, np.arange(len(off) - 1))
            at = np.flatnonzero(inside)
            h, x, row = h[at], (g[at] & np.uint64(255)).astype(np.uint8), of[at]
            pos, who = (at - first[row]).astype(np.int32), doc[row]
            order = np.argsort(h, kind="stable")
            again = np.zeros(len(h), bool)
            p, q = order[1:], order[:-1]
            again[p] = (h[p] == h[q]) & (x[p] == x[q]) & ((who[p] != who[q]) | (pos[p] != pos[q]))
            new = ~again
            # what repeats in here is removed whatever the others hold
            rows = [*deal(0, (h[new] % np.uint64(buckets)).astype(np.int32), 4, who[new], pos[new], h[new], x[new])]
            rows += deal(1, group_of(who[again], groups), 2, who[again], pos[again])
            if not rows:
                continue  # words enough in the slice, but no document with k of them
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 17), groups).astype(np.int32)


def _repeats(groups: int):
    def run(key, table):
        col = lambda n, t: np.concatenate([T.unpack(b, t) for b in table.column(n).to_pylist()])
        doc, pos, h, x = col("doc", np.int64), col("pos", np.int32), col("h", np.uint64), col("x", np.uint8)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = hs[1:] == hs[:-1]
        some = order[np.r_[same, False] | np.r_[False, same]]  # only hashes that occur again
        some = some[np.lexsort((pos[some], doc[some], x[some], h[some]))]
        doc, pos, h, x = doc[some], pos[some], h[some], x[some]
        head = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])] if len(h) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        gone = (doc != doc[lead]) | (pos != pos[lead])
        doc, pos = doc[gone], pos[gone]
        g = group_of(doc, groups)
        order = np.argsort(g, kind="stable")
        doc, pos, g = doc[order], pos[order], g[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        ends = [*cut[1:], len(g)][: len(cut)]
        return pa.table({"key": pa.array(g[cut], pa.int32()), "doc": pa.array([T.pack(doc[a:b]) for a, b in zip(cut, ends)], pa.binary()), "pos": pa.array([T.pack(pos[a:b]) for a, b in zip(cut, ends)], pa.binary())})

    return run


def intervals(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal word intervals [a, b) covered by windows of ``k`` words at the sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > k)
    return [(int(a), int(b) + k) for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]], strict=True)]


def _kept(k: int):
    def run(docs, gone):
        n = gone.num_rows
        who = np.concatenate([np.zeros(0, np.int64), *(T.unpack(b, np.int64) for b in gone.column("doc").to_pylist())])
        pos = np.concatenate([np.zeros(0, np.int32), *(T.unpack(b, np.int32) for b in gone.column("pos").to_pylist())])
        if n:
            order = np.lexsort((pos, who))
            who, pos = who[order], pos[order]
        doc = T.ids(docs.column("doc_id"))
        buf, off = T.strings(docs.column("text"))
        start, end, of = T.words(buf, off)
        word_at = np.searchsorted(of, np.arange(len(doc) + 1))
        lo, hi = np.searchsorted(who, doc, "left"), np.searchsorted(who, doc, "right")
        whole = buf.tobytes()
        rows = []
        for i in range(len(doc)):
            a, b = word_at[i], word_at[i + 1]
            spans = [(x, min(y, b - a)) for x, y in intervals(np.unique(pos[lo[i] : hi[i]]), k) if x < b - a]
            at, parts, left = a, [], 0
            for x, y in [*spans, (b - a, b - a)]:
                if a + x > at:  # words of one stretch, joined by one space whatever parted them
                    parts += whole[start[at] : end[a + x - 1]].split()
                at = a + y
                left += y - x
            rows.append((b - a, left, b" ".join(parts), [v for s in spans for v in s]))
        n_words, n_removed, kept, spans = zip(*rows, strict=True) if rows else ([], [], [], [])
        real = pc.if_else(docs.column("made"), pa.scalar(None, pa.int64()), docs.column("doc_id"))
        return pa.table({"doc_id": real, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    return run


def remove_repeats(docs: DataFrame, k: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text), spans (flat list of removed word intervals)."""
    size = text_bytes(docs)
    buckets, groups = max(64, size // _BUCKET_BYTES), max(64, size // _GROUP_BYTES)
    docs = docs.select(numbered(docs).alias("doc_id"), made_up().alias("made"), F.col("text").cast("string").alias("text"))
    repeats = _repeats(groups)

    def bucket(key, table):
        return table.select(["key", "doc", "pos"]) if key[0].as_py() else repeats(key, table)

    windows = docs.select("doc_id", "text").mapInArrow(_windows(k, buckets, groups), "kind int, key int, doc binary, pos binary, h binary, x binary")
    gone = dealt(windows, buckets, "kind", "key").groupBy("kind", "key").applyInArrow(bucket, "key int, doc binary, pos binary")
    at = F.col("doc_id")
    keyed = docs.withColumn("key", F.pmod(at.bitwiseXOR(F.shiftright(at, 17)), F.lit(groups)).cast("int"))
    return dealt(keyed, groups, "key").groupBy("key").cogroup(dealt(gone, groups, "key").groupBy("key")).applyInArrow(_kept(k), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>")
