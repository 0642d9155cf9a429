"""Katz backoff language model: counting, model tables and scoring of whole texts.

Texts are cut into chunks of a few million tokens, each with a dictionary of its
own, written once to a bucketed table. Everything that needs the whole corpus is
an exchange between chunks and buckets of hashes: a chunk sends each of its
distinct words (or word pairs) once with its count, a bucket adds up and answers
in the same order. A frequent word or pair is one entry per chunk however often
it occurs, so no key is hot and nothing of the corpus's size passes the driver.

Model of order 2, counts c from training documents, r <= 5 discounted by
Good-Turing (Katz's formula; absolute discounting where the counts of counts do
not allow it):

    P(w)     = d(c) c / N, what is left over is the unknown word's
    P(w | h) = s(h) d(c) c(h, w) / c(h)     where c(h, w) >= CUTOFF
             = alpha(h) P(w)                otherwise

alpha(h) makes the sum over all words and the unknown one exactly 1; s(h) is 1
but where nothing would be left to back off with, then c(h) / (c(h) + 1). The
first word's history is the start of the text; each text ends with an end token.
Every pair that was seen is in the model; CUTOFF is a parameter.

Words and pairs are 64-bit hashes. The model's tables are written, partitioned by
table and bucket: words (hash, count), pairs (hash, count from CUTOFF on) and
histories (hash, alpha, s).

Defined cases: null or empty text is the end token alone; a null doc_id is
training data; repeated rows count each time and each get a row; other input
columns are ignored; with no training documents N is 0 and every score is 0 at
base, and log10(1) in the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import dealt, new_path, new_table, text_bytes, written

CUTOFF, K = 1, 5
_CHUNK_BYTES = 12 << 20
_BUCKET_BYTES = 8 << 20
_C = np.uint64(0x9FB21C651E98DF25)
END, START = T.mix(np.array([0xE0D, 0x57A], np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[np.ndarray] = []
    train: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    held = 0

    def row() -> pa.RecordBatch:
        words, tokens, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank), dtype=np.uint32)
        cols = [np.concatenate(docs), np.concatenate(train), np.concatenate(sizes), np.r_[words[rank], START], place[tokens]]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([T.pack(c)], pa.binary()) for c in cols)], names=["chunk", "docs", "train", "sizes", "words", "tokens"])

    for piece in T.slices(batches, "text"):
        buf, off = T.strings(piece.column("text"))
        buf = T.lower_ascii(buf)
        start, end, of = T.words(buf, off)
        h = T.word_hashes(buf, start, end, 1)[0]
        n = np.bincount(of, minlength=piece.num_rows)
        stop = np.cumsum(n + 1) - 1  # an end token after each text
        all_h = np.empty(len(h) + len(n), np.uint64)
        inner = np.ones(len(all_h), bool)
        inner[stop] = False
        all_h[stop], all_h[inner] = END, h
        docs.append(piece.column("doc_id").fill_null(T.NULL_ID).to_numpy(zero_copy_only=False))
        nameless = piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        train.append(piece.column("train").to_numpy(zero_copy_only=False).astype(np.uint8) + np.uint8(2) * nameless)
        sizes.append(n + 1)
        hashes.append(all_h)
        held += len(buf)
        if held >= _CHUNK_BYTES:
            yield row()
            docs, train, sizes, hashes, held = [], [], [], [], 0
    if docs:
        yield row()


class _Chunk:
    """One row of the chunks' table, unpacked."""

    def __init__(self, get):
        flags = T.unpack(get("train"), np.uint8)
        self.docs, self.train, self.sizes = T.unpack(get("docs"), np.int64), (flags & 1).astype(bool), T.unpack(get("sizes"), np.int64)
        self.nameless = (flags & 2).astype(bool)
        self.words, self.tokens = T.unpack(get("words"), np.uint64), T.unpack(get("tokens"), np.uint32).astype(np.int64)
        self.learnt = np.repeat(self.train, self.sizes)

    def word_counts(self) -> np.ndarray:
        count = np.bincount(self.tokens[self.learnt], minlength=len(self.words))
        count[-1] = self.train.sum()
        return count

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by hash: hash, history, word, count in training documents; and each token's pair."""
        before = np.r_[0, self.tokens[:-1]]
        before[np.cumsum(self.sizes) - self.sizes] = len(self.words) - 1
        code, which = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        h, w = code // len(self.words), code % len(self.words)
        key = T.mix(self.words[h] * _C + self.words[w])
        order = np.argsort(key, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        which = back[which]
        count = np.bincount(which[self.learnt], minlength=len(order))
        return key[order], h[order], w[order], count, which


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted hashes: differences, in 6 bytes each where they fit."""
    d = np.diff(keys, prepend=np.uint64(0))
    wide = bool(len(d)) and int(d.max()) >= 1 << 48
    raw = np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 6]
    return bytes([wide]) + raw.tobytes()


def _undelta(b: bytes) -> np.ndarray:
    k = 8 if b[0] else 6
    raw = np.zeros(((len(b) - 1) // k, 8), np.uint8)
    raw[:, :k] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, k)
    return np.cumsum(raw.view(np.uint64).ravel(), dtype=np.uint64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that a bucket's keys are near each other."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


_ASK = "bucket int, chunk long, keys binary, a binary, b binary"


def _ask(chunk: int, keys: np.ndarray, buckets: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket that a chunk has keys for."""
    of = _bucket_of(keys, buckets)
    order = np.lexsort((keys, of))
    of, keys, a = of[order], keys[order], a[order]
    b = b[order] if b is not None else None
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    ends = [*cut[1:], len(of)]
    col = lambda x: [T.pack(x[i:j]) for i, j in zip(cut, ends, strict=True)] if x is not None else [None] * len(cut)
    return pa.RecordBatch.from_arrays([pa.array(of[cut].astype(np.int32)), pa.array([chunk] * len(cut), pa.int64()), pa.array([_deltas(keys[i:j]) for i, j in zip(cut, ends, strict=True)], pa.binary()), pa.array(col(a), pa.binary()), pa.array(col(b), pa.binary())], names=["bucket", "chunk", "keys", "a", "b"])


_ANSWER = "kind string, bucket int, chunk long, keys binary, a binary, b binary, stats array<long>"
_ANSWER_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANSWER_TYPES, strict=True)], names=[c.split()[0] for c in _ANSWER.split(", ")])


def _add_up(kind: str, cutoff: int):
    """Total counts for a bucket's keys: the table's part, and an answer to every chunk (count, and whether it speaks for the key)."""

    def run(key, table):
        bucket = key[0].as_py()
        order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
        keys = [_undelta(table.column("keys")[int(i)].as_py()) for i in order]
        counts = [T.unpack(table.column("a")[int(i)].as_py(), np.int64) for i in order]
        every, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        real = total[every != START]  # the start of a text is a history, not a word
        stats = [int(real.sum()), int((real > 0).sum()), *(int((real == r).sum()) for r in range(1, K + 2))]
        keep = total >= cutoff
        rows = [(kind, bucket, -1, T.pack(every[keep]), T.pack(total[keep]), None, stats)]
        total[~keep] = 0
        owner = np.zeros(len(which), np.uint8)
        owner[first] = 1
        at = 0
        for i, k in zip(order, keys, strict=True):
            w = which[at : at + len(k)]
            rows.append((f"{kind} answer", bucket, int(table.column("chunk")[int(i)].as_py()), None, T.pack(total[w]), T.pack(np.packbits(owner[at : at + len(k)] & (total[w] > 0))), None))
            at += len(k)
        return _answers(rows)

    return run


def discounts(n: list[int], cutoff: int = 1) -> np.ndarray:
    """d(0..K) from the counts of counts n[1..K+1]; counts under the cutoff get 0."""
    d = np.ones(K + 1)
    d[0] = 0
    n1 = n[0]
    a = (K + 1) * n[K] / n1 if n1 else 1.0
    good = n1 > 0 and a < 1 and all(n)
    if good:
        for r in range(1, K + 1):
            d[r] = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
        good = all(0 < x < 1 for x in d[1:])
    if not good:  # copies in a corpus can make Katz's formula meaningless
        less = n1 / (n1 + 2 * n[1]) if n1 else 0.5
        less = min(max(less, 0.1), 0.9)
        d[1:] = (np.arange(1, K + 1) - less) / np.arange(1, K + 1)
    d[:cutoff] = 0
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > K, c, d[np.minimum(c, K)] * c)


class _Unigrams:
    """Numbers of the whole training corpus."""

    def __init__(self, stats: list[int]):
        self.n, self.v, counts = stats[0], stats[1], stats[2:]
        self.d = discounts(counts)
        over = self.n - sum(r * x for r, x in enumerate(counts[:K], 1))
        mass = over + sum(self.d[r] * r * counts[r - 1] for r in range(1, K + 1))
        self.scale = 1 / self.n if self.n and mass < self.n else 1 / (self.n + 1)
        self.unknown = 1 - mass * self.scale

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d) * self.scale, self.unknown)


def _spread(chunk_keys: np.ndarray, buckets: int, parts: dict[int, tuple], which: int, dtype) -> np.ndarray:
    """Answers of all buckets, in the order of the keys that asked."""
    of = _bucket_of(chunk_keys, buckets)
    order = np.lexsort((chunk_keys, of))
    out = np.zeros(len(chunk_keys), dtype)
    out[order] = np.concatenate([np.zeros(0, dtype), *(parts[b][which] for b in sorted(parts))])
    return out


def _collected(table, buckets: int) -> dict[str, dict[int, tuple]]:
    out: dict[str, dict[int, tuple]] = {}
    for kind, bucket, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True):
        if kind == "history answer":
            out.setdefault(kind, {})[bucket] = (T.unpack(a, np.float64), T.unpack(b, np.float64))
        else:
            n = T.unpack(a, np.int64)
            out.setdefault(kind, {})[bucket] = (n, np.unpackbits(T.unpack(b, np.uint8))[: len(n)].astype(bool))
    return out


def model_and_scores(docs: DataFrame, held_out: Column, cutoff: int = CUTOFF) -> tuple[DataFrame, DataFrame]:
    """(scores, model tables). Scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    buckets = max(64, size // _BUCKET_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    name = new_table("chunks")
    chunks = docs.mapInArrow(_chunks, "chunk long, docs binary, train binary, sizes binary, words binary, tokens binary")
    # bucketed by chunk: the two joins below read it without a shuffle
    chunks.write.option("path", new_path(spark, "chunks")).option("compression", "none").bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)

    def each(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield f(batch.column("chunk")[i].as_py(), _Chunk(lambda c: batch.column(c)[i].as_py()))

        return run

    def add_up(kind: str, ask, least: int) -> tuple[DataFrame, list[int]]:
        found = written(chunks.mapInArrow(each(ask), _ASK).transform(dealt, buckets, "bucket").groupBy("bucket").applyInArrow(_add_up(kind, least), _ANSWER), kind)
        sums = found.where(F.col("kind") == kind).agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3))).first()
        return found, [int(x or 0) for x in sums]

    words, stats = add_up("word", lambda i, c: _ask(i, c.words, buckets, c.word_counts()), 1)

    def ask_pairs(i: int, c: _Chunk) -> pa.RecordBatch:
        key, _, _, count, _ = c.pairs()
        return _ask(i, key, buckets, count)

    pairs, pair_stats = add_up("pair", ask_pairs, cutoff)
    one, d = _Unigrams(stats), discounts(pair_stats[2:], cutoff)
    answers = words.where("kind = 'word answer'").unionByName(pairs.where("kind = 'pair answer'")).select("kind", "chunk", "bucket", "a", "b")

    def ask_histories(left, right):
        """A chunk speaks for the pairs that it owns: discounted counts and unigram probabilities, added up by history."""
        rows = []
        for i in range(left.num_rows):
            c, got = _Chunk(lambda k: left.column(k)[i].as_py()), _collected(right, buckets)
            count = _spread(c.words, buckets, got["word answer"], 0, np.int64)
            key, h, w, _, _ = c.pairs()
            n, own = (_spread(key, buckets, got["pair answer"], x, t) for x, t in ((0, np.int64), (1, bool)))
            a = np.bincount(h[own], _discounted(n[own], d), len(c.words))
            b = np.bincount(h[own], one.p(count[w[own]]), len(c.words))
            rows.append(pa.Table.from_batches([_ask(left.column("chunk")[i].as_py(), c.words, buckets, np.where(a > 0, a, 0.0), np.where(a > 0, b, 0.0))]))
        return pa.concat_tables(rows) if rows else pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]).empty_table()

    asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_histories, _ASK)
    counts = words.where("kind = 'word'").select("bucket", F.lit(-1).cast("long").alias("chunk"), "keys", "a", F.lit(None).cast("binary").alias("b"))

    def histories(key, table):
        bucket, rows = key[0].as_py(), []
        own = [i for i, c in enumerate(table.column("chunk").to_pylist()) if c < 0]
        known = T.unpack(table.column("keys")[own[0]].as_py(), np.uint64) if own else np.zeros(0, np.uint64)
        total = T.unpack(table.column("a")[own[0]].as_py(), np.int64).astype(float) if own else np.zeros(0)
        asks = [i for i in range(table.num_rows) if i not in own]
        asks.sort(key=lambda i: table.column("chunk")[i].as_py())
        keys = [_undelta(table.column("keys")[i].as_py()) for i in asks]
        if not keys:
            return _answers(rows) if rows else _answers([("history", bucket, -1, T.pack(known[:0]), T.pack(np.zeros(0)), T.pack(np.zeros(0)), None)])
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        a, b = (np.bincount(which, np.concatenate([T.unpack(table.column(c)[i].as_py(), np.float64) for i in asks]), len(every)) for c in ("a", "b"))
        n = np.zeros(len(every))
        at = np.searchsorted(every, known)
        hit = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == known)
        n[at[hit]] = total[hit]
        some = (a > 0) & (n > 0)
        share = np.divide(a, n, out=np.zeros(len(n)), where=some)
        scale = np.where(some & (share > 1 - 1e-9), n / (n + 1), 1.0)
        alpha = np.where(some, (1 - share * scale) / np.maximum(1 - b, 1e-300), 1.0)
        rows.append(("history", bucket, -1, T.pack(every[some]), T.pack(alpha[some]), T.pack(scale[some]), None))
        at = 0
        for i, k in zip(asks, keys, strict=True):
            w = which[at : at + len(k)]
            rows.append(("history answer", bucket, table.column("chunk")[i].as_py(), None, T.pack(alpha[w]), T.pack(scale[w]), None))
            at += len(k)
        return _answers(rows)

    past = written(dealt(asked.unionByName(counts), buckets, "bucket").groupBy("bucket").applyInArrow(histories, _ANSWER), "history")
    every = answers.unionByName(past.where("kind = 'history answer'").select("kind", "chunk", "bucket", "a", "b"))

    def score(left, right):
        out = []
        for i in range(left.num_rows):
            c, got = _Chunk(lambda k: left.column(k)[i].as_py()), _collected(right, buckets)
            count = _spread(c.words, buckets, got["word answer"], 0, np.int64)
            alpha, scale = (_spread(c.words, buckets, got["history answer"], x, np.float64) for x in (0, 1))
            key, h, w, _, which = c.pairs()
            n = _spread(key, buckets, got["pair answer"], 0, np.int64)
            seen = (n > 0) & (count[h] > 0)
            p = np.where(seen, scale[h] * _discounted(n, d) / np.maximum(count[h], 1), alpha[h] * one.p(count[w]))
            lp = np.log10(p)[which]
            base = np.log10((count + 1) / (one.n + one.v + 1))[c.tokens]
            at = np.cumsum(c.sizes) - c.sizes
            out.append(pa.table({"doc_id": pa.array(c.docs, mask=c.nameless), "held_out": ~c.train, "n_tokens": c.sizes, "n_known": np.add.reduceat((count > 0)[c.tokens].astype(np.int64), at), "train_tokens": np.full(len(at), one.n), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(lp, at)}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    scores = chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    tables = [t.where(F.col("kind") == k).select("kind", "bucket", "keys", "a", "b") for t, k in ((words, "word"), (pairs, "pair"), (past, "history"))]
    return scores, tables[0].unionByName(tables[1]).unionByName(tables[2])
