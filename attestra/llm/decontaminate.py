"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose which of a few consecutive word positions count; words at the
other positions may be anything. The four masks here hit every stretch of 13 or more
words with at least 0.8 equal ones, wherever the others are. Hashes of the masked
words join test items and documents; around each hit the two word sequences are
compared along the diagonal, and the longest stretch of at least ``min_words``
words (or a whole shorter item) with at least ``share`` equal words is an overlap,
then the longest on each side of it, and so on. Unequal words at its ends are cut
off as far as the least length allows. Shorter items have masks of their own: one
part more than words may differ, so that one part is equal. A ``share`` under 0.8
or ``min_words`` under 13 is compared the same, but the masks may miss some.

The test set is a query set against all rows: it is broadcast in blocks of about
BLOCK_BYTES of text, one at a time, so one pass over the documents serves a block.

Defined cases: null or empty texts and items overlap with nothing; a null doc_id
or item_id stays null; rows that repeat a document or an item add nothing to its
pair's row but n_overlaps; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import free_names, written

MASKS = ("10111011", "1011000111", "101100001011", "11111001")
LEAST = 13
#: Bytes of test-set text broadcast at once.
BLOCK_BYTES = 4 << 20
#: Pairs of places looked at once: hot words and repeats cost time, not memory.
PAIRS = 1 << 20
_BITS = 24
_OUT = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _masked(w: np.ndarray, of: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every place where the mask fits in one text."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, salt, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = h * _C + w[i : i + n]
    at = np.flatnonzero(of[:n] == of[len(mask) - 1 :])
    return at, T.mix(h[at])


def _earlier(at: np.ndarray, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The key of the same mask one word earlier in the same text, or 0. ``at`` ascends within each mask."""
    out = np.zeros(len(keys), np.uint64)
    follows = (at[1:] == at[:-1] + 1) & (of[at[1:]] == of[at[:-1]])
    out[1:][follows] = keys[:-1][follows]
    return out


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text of each word, first word of each text and the end) of lower-cased texts."""
    buf, off = T.strings(pa.array([t.lower() for t in texts], pa.string()))
    start, end, of = T.words(buf, off)
    return T.word_hashes(buf, start, end, 1)[0], of, np.searchsorted(of, np.arange(len(texts) + 1))


def _paired(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    return T.mix(keys * _C + before)


def _seeds(w: np.ndarray, of: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [_masked(w, of, m, 1 + i) for i, m in enumerate(masks)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stretches(equal: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """The longest stretch of at least ``least`` words with at least ``share`` equal ones, then the same on both sides of it."""
    part = Fraction(share).limit_denominator(10**6)
    value = np.where(equal, part.denominator - part.numerator, -part.numerator)
    out, todo = [], [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        total = np.r_[0, np.cumsum(value[a:b])]
        low = np.minimum.accumulate(total)
        start = np.searchsorted(-low, -total)  # the first place whose sum is not above
        end = int(np.argmax(np.arange(len(total)) - start))
        x, y = a + int(start[end]), a + end
        if y - x < least:
            continue
        while y - x > least and not equal[y - 1]:
            y -= 1
        while y - x > least and not equal[x]:
            x += 1
        out.append((x, y))
        todo += [(a, x), (y, b)]
    return out


def _finder(min_words: int, share: float, block):
    """A function from a batch with ``text`` to its overlaps with a block: (row, item_id, doc_start, item_start, n_words, n_equal)."""

    def find(piece: pa.RecordBatch) -> list[tuple]:
        names, iw, ifirst, keys, where, groups, spans, masks = block.value
        if not len(keys):
            return []
        iof = np.searchsorted(ifirst, np.arange(len(iw)), "right") - 1
        shift = np.uint64(64 - _BITS)
        table = np.zeros(1 << _BITS, bool)
        table[keys >> shift] = True
        w, of, first = _hashed([t or "" for t in piece.column("text").to_pylist()])
        at, h = _seeds(w, of, masks)
        before = _earlier(at, h, of)
        hit = np.flatnonzero(table[h >> shift])
        at, h, before = at[hit], h[hit], before[hit]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        # places in items where the word before hits as well lie on a diagonal that is known: left out
        pair = _paired(h, before)
        g = np.minimum(np.searchsorted(groups, pair), len(groups) - 1)
        known = (before != 0) & (groups[g] == pair) & (hi > lo)
        a, b = np.where(known, spans[g, 0], hi), np.where(known, spans[g, 1], hi)
        start, n = np.r_[lo, b], np.r_[a - lo, hi - b]
        at, start, n = np.tile(at, 2)[n > 0], start[n > 0], n[n > 0]
        width, base = np.int64(len(w) + len(iw) + 1), np.int64(len(iw))
        seen = np.zeros(0, np.int64)
        upto = np.cumsum(n)
        x = 0
        while x < len(n):  # in blocks of pairs; one place has at most as many as the block of items has words
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
            m = n[x:y]
            doc_at = np.repeat(at[x:y], m)
            item_at = where[np.repeat(start[x:y], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            seen = np.union1d(seen, (of[doc_at].astype(np.int64) * len(names) + iof[item_at]) * width + (doc_at - item_at + base))
            x = y
        both, diagonals = seen // width, seen % width - base
        rows = []
        for d, i, diagonal in zip((both // max(1, len(names))).tolist(), (both % max(1, len(names))).tolist(), diagonals.tolist(), strict=True):
            a = max(int(ifirst[i]), int(first[d]) - diagonal)
            b = min(int(ifirst[i + 1]), int(first[d + 1]) - diagonal)
            equal = iw[a:b] == w[a + diagonal : b + diagonal]
            for x, y in _stretches(equal, share, min(min_words, int(ifirst[i + 1] - ifirst[i]))):
                rows.append((d, names[i], a + x + diagonal - int(first[d]), a + x - int(ifirst[i]), y - x, int(equal[x:y].sum())))
        return rows

    return find


def _short_masks(m: int, share: float) -> list[str]:
    """Masks as wide as an item of m words, in parts of neighbouring words: one part more than words may differ."""
    parts = int((1 - Fraction(share).limit_denominator(10**6)) * m) + 1
    return ["".join("01"[i * parts // m == k] for i in range(m)) for k in range(parts)]


def _blocks(items: DataFrame, share: float) -> tuple[int, Callable]:
    """The number of blocks of about BLOCK_BYTES of test-set text, and a function that broadcasts one: names, word hashes, first words, sorted keys and their places, masks."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows = sorted({(r["item_id"], r["text"]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w, of, first = _hashed([r[1] for r in rows])
        short = [x for m in sorted({int(n) for n in np.diff(first) if 0 < n < LEAST}) for x in _short_masks(m, share)]
        at, keys = _seeds(w, of, list(MASKS))
        for i, m in enumerate(short):  # whole short items only
            a, h = _masked(w, of, m, 1 + len(MASKS) + i)
            whole = np.diff(first)[of[a]] == len(m)
            at, keys = np.r_[at, a[whole]], np.r_[keys, h[whole]]
        before = _earlier(at, keys, of)
        order = np.lexsort((before, keys))
        keys, before = keys[order], before[order]
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])]) if len(keys) else np.zeros(0, np.int64)
        groups, spans = _paired(keys[edge], before[edge]), np.stack([edge, np.r_[edge[1:], len(keys)][: len(edge)]], 1)
        by = np.argsort(groups, kind="stable")
        return items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], w, first, keys, at[order], groups[by], spans[by], [*MASKS, *short]))

    return n, block


def _scanned(docs: DataFrame, items: DataFrame, min_words: int, share: float, out: str, rows_of) -> DataFrame:
    """``rows_of(finder)`` over the documents for each block of the test set. One block is one lazy pass; of several, each one's hits are written and its broadcast freed before the next is made."""
    n, block = _blocks(items, share)
    if n == 1:
        return docs.mapInArrow(rows_of(_finder(min_words, share, block(0))), out)
    parts = []
    for k in range(n):
        held = block(k)
        parts.append(written(docs.mapInArrow(rows_of(_finder(min_words, share, held)), out), "overlaps"))
        held.unpersist()
    return reduce(DataFrame.unionByName, parts)


def overlaps(docs: DataFrame, items: DataFrame, min_words: int = 13, share: float = 0.8) -> DataFrame:
    """One row for each overlap: doc_id, item_id, doc_start, item_start, n_words, n_equal (in words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c.split()[0] for c in _OUT.split(", ")]

    def scan(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in T.slices(batches, "text"):
                if rows := find(piece):
                    ids = piece.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[1:])], names=names)

        return run

    return _scanned(docs, items, min_words, share, _OUT, scan)


def clean(docs: DataFrame, items: DataFrame, min_words: int = 13, share: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no item. Where the test set has several blocks, texts that any of them hits are written by hash and joined away."""
    if _blocks(items, share)[0] == 1:

        def keep(find):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for piece in T.slices(batches, "text"):
                    good = np.ones(piece.num_rows, bool)
                    good[[r[0] for r in find(piece)]] = False
                    yield piece.filter(pa.array(good))

            return run

        return _scanned(docs, items, min_words, share, docs.schema, keep)

    def hit(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in T.slices(batches, "text"):
                some = pa.array(sorted({r[0] for r in find(piece)}), pa.int64())
                yield piece.select(["lo", "hi"]).take(some)

        return run

    (lo, hi), text = free_names(docs, 2), F.col("text").cast("string")
    keys = docs.select(F.xxhash64(text).alias("lo"), F.xxhash64(text, F.lit(1)).alias("hi"), text.alias("text"))
    found = _scanned(keys, items, min_words, share, "lo long, hi long", hit).distinct().select(F.col("lo").alias(lo), F.col("hi").alias(hi))
    return docs.withColumn(lo, F.xxhash64(text)).withColumn(hi, F.xxhash64(text, F.lit(1))).join(found, [lo, hi], "left_anti").drop(lo, hi)


def contaminated(docs: DataFrame, items: DataFrame, min_words: int = 13, share: float = 0.8) -> DataFrame:
    """One row for each document and item that overlap: n_overlaps, and the longest one's place and size."""
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    found = overlaps(docs, items, min_words, share).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), best.alias("b"))
    return found.select("doc_id", "item_id", "n_overlaps", F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"), (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))
