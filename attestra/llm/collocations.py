"""Phrase collocations from generalised suffix automata, one for each shard of the corpus.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and 0A to 0D, and pieces
into words at blanks and tabs. A shard is a few MB of text with a dictionary of its own.
Its automaton has a state for each class of substrings that end at the same places; the
suffix links of these states form the tree of the reversed pieces, so states, links and
counts of end places come from sorting places by the word there, the word before, and so
on, as deep as phrases may be long. An automaton is deepened by a word at a time: a
phrase is looked at only where the phrases without its last and without its first word
are frequent in the whole corpus, which loses no candidate.

Counts are added up by an exchange: a shard sends each bucket of hashes its substrings
with their counts, a bucket adds them up and answers with the total counts of what is
frequent. A frequent word or phrase is one entry for each shard, so no key is hot. The
first shard that has a frequent phrase speaks for it: it knows the counts of all its
parts, scores its cuts, and names the shorter phrase that a suffix link (or the way
back by the last word) leads to where the longer one takes the place of it. What is
named so is joined away, and the best of each language are found by a window that keeps
only the first rows of each partition before it shuffles.

Messages go from each shard to each bucket it has keys for: their number grows with the
square of the input until each holds one key, and is never more than the shards' distinct
substrings. Words and phrases are 64-bit hashes of language and words until they are
scored; fewer than three collisions are expected among 10^10 phrases. Scores are whole
numbers of any size.

Defined cases: a null or empty text has no words; a null lang is ``und``; repeated rows
count each time; ties in score and count follow the phrase; an empty table gives no rows;
doc_id and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.llm import _text as T
from attestra.llm._shared import dealt, new_path, new_table, text_bytes, written
from attestra.llm.katz import _bucket_of, _deltas, _undelta

MOST_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2_000
_SHARD_BYTES = 4 << 20
_BUCKET_BYTES = 4 << 20
_CUTS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
_C = np.uint64(0xA24BAED4963EE407)

_SHARD = "shard long, langs array<string>, n array<long>, words binary, sizes binary, lang binary, keys binary, tokens binary, starts binary"


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _shard(bufs: list[np.ndarray], offs: list[np.ndarray], of_text: list[str]) -> pa.RecordBatch:
    buf = T.lower_ascii(np.concatenate(bufs))
    base = np.cumsum([0, *(len(b) for b in bufs)])
    off = np.concatenate([o[:-1] + b for o, b in zip(offs, base, strict=False)] + [base[-1:]])
    cut = np.isin(buf, _CUTS)
    start, end, of = T.words(np.where(cut, np.uint8(32), buf), off)
    names = sorted(set(of_text))
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in of_text], np.int64)[of]
    seeds = np.array([_seed(x) for x in names], np.uint64)
    key = T.mix(T.word_hashes(buf, start, end, 1)[0] ^ seeds[lang]) if len(start) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(np.flatnonzero(cut), start)  # cuts before each word
    starts = np.ones(len(start), bool)
    starts[1:] = (of[1:] != of[:-1]) | (cuts[1:] != cuts[:-1])
    del of, cut, cuts
    keys, first, tokens, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress
    place = np.empty(len(rank), np.uint32)
    place[rank] = np.arange(len(rank), dtype=np.uint32)
    first = first[rank]
    text = b"".join(buf[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True))
    n = np.bincount(lang, minlength=len(names))
    cols = [np.frombuffer(text, np.uint8), (end - start)[first], lang[first], keys[rank], place[tokens], np.packbits(starts)]
    packed = [pa.array([T.pack(c)], pa.binary()) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([names], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64())), *packed], names=[c.split()[0] for c in _SHARD.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bufs: list[np.ndarray] = []
    offs: list[np.ndarray] = []
    langs: list[str] = []
    held = 0
    for piece in T.slices(batches, "text", _SHARD_BYTES // 4):
        buf, off = T.strings(piece.column("text"))
        bufs.append(buf)
        offs.append(off)
        langs += piece.column("lang").to_pylist()
        held += len(buf)
        if held >= _SHARD_BYTES:
            yield _shard(bufs, offs, langs)
            bufs, offs, langs, held = [], [], [], 0
    if langs:
        yield _shard(bufs, offs, langs)


class _Level:
    """The substrings of one length: by number their key, count of end places, last end place, and the substrings without their first and without their last word; by place the number of the one that ends there, or -1."""

    def __init__(self, at: np.ndarray, key: np.ndarray, count: np.ndarray, end: np.ndarray, suffix: np.ndarray, prefix: np.ndarray):
        self.at, self.key, self.count, self.end, self.suffix, self.prefix = at, key, count, end, suffix, prefix
        self.order = np.argsort(key, kind="stable")
        self.total = np.zeros(len(key), np.int64)
        self.owned = np.zeros(len(key), bool)

    def learn(self, total: np.ndarray, owned: np.ndarray) -> None:
        """Counts in the whole corpus (0 where not frequent), in the order of keys."""
        self.total[self.order], self.owned[self.order] = total, owned


class Automaton:
    """The suffix automaton of a shard's pieces, to a depth that grows by ``deepen``."""

    def __init__(self, get: Callable[[str], bytes]):
        self.keys, self.tokens = T.unpack(get("keys"), np.uint64), T.unpack(get("tokens"), np.uint32).astype(np.int64)
        self.starts = np.unpackbits(T.unpack(get("starts"), np.uint8))[: len(self.tokens)].astype(bool)
        n, none = len(self.keys), np.zeros(len(self.keys), np.int64)
        end = none.copy()
        end[self.tokens] = np.arange(len(self.tokens))
        self.levels = [_Level(self.tokens, self.keys, np.bincount(self.tokens, minlength=n), end, none, none)]
        self._get = get

    def deepen(self, known: bool) -> None:
        """Adds the substrings one word longer: sorted by the shorter one that is their suffix, then by the word before it. Where the shorter ones' total counts are known, only those whose two shorter ones are frequent."""
        below = self.levels[-1]
        here = below.at.copy()
        if known and len(here):
            here[(here >= 0) & (below.total[here] == 0)] = -1
        before = np.r_[np.int64(-1), here[:-1]]
        place = np.flatnonzero((here >= 0) & (before >= 0) & ~self.starts)
        width = max(1, len(below.key))
        code, first, which, count = np.unique(here[place] * width + before[place], return_index=True, return_inverse=True, return_counts=True)
        at = np.full(len(here), -1, np.int64)
        at[place] = which
        suffix, prefix, end = code // width, code % width, place[first]
        self.levels.append(_Level(at, T.mix(below.key[prefix] * _C + self.keys[self.tokens[end]]), count, end, suffix, prefix))

    def states(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(state of each substring by length, end places of each state, suffix link of each state; -1 is the empty string's).

        A substring with as many end places as its suffix has the same ones and shares its state.
        """
        of, ends, links = [], [], []
        made = 0
        for k, level in enumerate(self.levels):
            same = level.count == self.levels[k - 1].count[level.suffix] if k else np.zeros(len(level.key), bool)
            state = np.empty(len(level.key), np.int64)
            up = of[-1][level.suffix] if k else np.full(len(level.key), -1, np.int64)
            state[same] = up[same]
            state[~same] = made + np.arange((~same).sum())
            ends.append(level.count[~same])
            links.append(up[~same])
            made += int((~same).sum())
            of.append(state)
        return of, np.concatenate(ends), np.concatenate(links)

    def counts(self, k: int) -> np.ndarray:
        """Counts of the substrings of k words: the end places of their states."""
        of, ends, _ = self.states()
        return ends[of[k - 1]]

    def phrases(self, k: int, which: np.ndarray) -> tuple[list[str], list[int]]:
        """(text, number of the language) of substrings of k words."""
        size = T.unpack(self._get("sizes"), np.int64)
        to = np.cumsum(size).tolist()
        raw = T.unpack(self._get("words"), np.uint8).tobytes()
        size = size.tolist()
        word = lambda t: raw[to[t] - size[t] : to[t]]
        ends = self.levels[k - 1].end[which].tolist()
        tokens = self.tokens
        lang = T.unpack(self._get("lang"), np.int64)
        return [b" ".join(word(t) for t in tokens[e - k + 1 : e + 1].tolist()).decode() for e in ends], lang[tokens[ends]].tolist() if ends else []


_ASK = "bucket int, shard long, keys binary, n binary"
_ANSWER = "shard long, bucket int, words int, frequent binary, owned binary, n binary"


def _ask(shard: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that sorted keys fall into."""
    of = _bucket_of(keys, buckets)
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True)) if len(cut) else []
    cols = [pa.array(of[cut], pa.int32()), pa.array([shard] * len(cut), pa.int64()), pa.array([_deltas(keys[i:j]) for i, j in spans], pa.binary()), pa.array([T.pack(counts[i:j].astype(np.uint32)) for i, j in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ASK.split(", ")])


def _added(words: int, least: int):
    """A bucket's answers: to each shard, which of its keys are frequent, which of these it speaks for, and their total counts."""

    def run(key, table):
        order = np.argsort(table.column("shard").to_numpy(), kind="stable").tolist()
        keys = [_undelta(table.column("keys")[i].as_py()) for i in order]
        every, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, which, np.concatenate([T.unpack(table.column("n")[i].as_py(), np.uint32).astype(np.int64) for i in order]))
        owner = np.zeros(len(which), bool)
        owner[first] = True
        rows, at = [], 0
        for i, k in zip(order, keys, strict=True):
            n = total[which[at : at + len(k)]]
            some = n >= least
            rows.append((table.column("shard")[i].as_py(), key[0].as_py(), words, np.packbits(some).tobytes(), np.packbits(owner[at : at + len(k)][some]).tobytes(), T.pack(n[some])))
            at += len(k)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _ANSWER.split(", ")])

    return run


def _answered(table, words: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(total counts or 0, whether the shard speaks for the key) of sorted keys."""
    total, owned = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    edge = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
    for w, b, some, own, n in zip(*(table.column(c).to_pylist() for c in ("words", "bucket", "frequent", "owned", "n")), strict=True):
        if w == words:
            size = int(edge[b + 1] - edge[b])
            at = edge[b] + np.flatnonzero(np.unpackbits(np.frombuffer(some, np.uint8))[:size])
            total[at] = T.unpack(n, np.int64)
            owned[at] = np.unpackbits(np.frombuffer(own, np.uint8))[: len(at)]
    return total, owned


def score(a: int, left: int, right: int) -> int:
    return 1_000_000 * a * a // (left * right)


def _cut(a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left count, right count, score) of each phrase's lowest-scoring cut, the first among equals. Whole numbers of any size where 64 bits don't hold the products."""
    small = len(a) == 0 or (int(a.max()) < 2_000_000 and all(int(x.max()) < 1 << 31 and int(y.max()) < 1 << 31 for x, y in cuts))
    kind = np.int64 if small else object
    best = None
    for x, y in cuts:
        s = 1_000_000 * a.astype(kind) ** 2 // (x.astype(kind) * y.astype(kind))
        if best is None:
            best = [x, y, s]
        else:
            lower = (s < best[2]).astype(bool)
            best = [np.where(lower, new, old) for new, old in zip((x, y, s), best, strict=True)]
    return best[0], best[1], best[2].astype(np.int64)


_PHRASE = "key long, lang string, words int, phrase string, a long, l long, r long, score long"
_PHRASE_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _scored(auto: Automaton, langs: list[str], share: int) -> pa.Table:
    """Phrases that a shard speaks for, and keys (without a phrase) of shorter ones that longer ones take the place of."""
    parts, gone = [], []
    single = auto.levels[0].total
    for k in range(2, len(auto.levels) + 1):
        level, below = auto.levels[k - 1], auto.levels[k - 2]
        own = np.flatnonzero(level.owned & (level.total > 0))
        a = level.total[own]
        if k > 2:
            for shorter in (level.suffix[own], level.prefix[own]):
                gone.append(below.key[shorter[100 * a >= share * below.total[shorter]]])
        # numbers of the substrings that end, and begin, each phrase, by their words
        first, last = {k: own}, {k: own}
        for j in range(k, 1, -1):
            first[j - 1], last[j - 1] = auto.levels[j - 1].prefix[first[j]], auto.levels[j - 1].suffix[last[j]]
        count = lambda j, of: single[of] if j == 1 else auto.levels[j - 1].total[of]
        x, y, s = _cut(a, [(count(j, first[j]), count(k - j, last[k - j])) for j in range(1, k)])
        text, lang = auto.phrases(k, own)
        parts.append(pa.table([pa.array(level.key[own].view(np.int64)), pa.array([langs[i] for i in lang], pa.string()), pa.array(np.full(len(own), k, np.int32)), pa.array(text, pa.string()), pa.array(a), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(s)], schema=_SCORED))
    named = np.unique(np.concatenate(gone)) if gone else np.zeros(0, np.uint64)
    parts.append(pa.table([pa.array(named.view(np.int64)), *(pa.nulls(len(named), f.type) for f in list(_SCORED)[1:])], schema=_SCORED))
    return pa.concat_tables(parts)


_SCORED = pa.schema(list(zip([c.split()[0] for c in _PHRASE.split(", ")], _PHRASE_TYPES, strict=True)))


def candidates(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(phrases of 2 to ``most_words`` words that occur ``least`` times or more, but those that a longer one with ``share`` hundredths of their count or more takes the place of: lang, words, phrase, a, l, r, score; words in each language: lang, n)."""
    spark = docs.sparkSession
    buckets = max(16, text_bytes(docs) // _BUCKET_BYTES)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    name = new_table("shards")
    # bucketed by shard: the joins below read it without a shuffle
    docs.mapInArrow(_shards, _SHARD).write.option("path", new_path(spark, "shards")).option("compression", "none").bucketBy(buckets, "shard").saveAsTable(name)
    shards = spark.table(name)
    n = shards.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n")).where("n > 0")

    def added(asked: DataFrame, words: int) -> DataFrame:
        return written(dealt(asked, buckets, "bucket").groupBy("bucket").applyInArrow(_added(words, least), _ANSWER), "totals")

    def grown(row: Callable[[str], bytes], table) -> Automaton:
        """A shard's automaton with the total counts of all that was asked so far, and the level to ask for next."""
        auto = Automaton(row)
        for words in range(1, most_words):
            got = _answered(table, words, auto.levels[-1].key[auto.levels[-1].order], buckets)
            auto.levels[-1].learn(*got)
            auto.deepen(known=True)
        return auto

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                auto = Automaton(lambda c, i=i: batch.column(c)[i].as_py())
                order = auto.levels[0].order
                yield _ask(batch.column("shard")[i].as_py(), auto.keys[order], auto.counts(1)[order], buckets)

    needed = ["shard", "langs", "words", "sizes", "lang", "keys", "tokens", "starts"]
    answers = added(shards.select("shard", "keys", "tokens", "starts").mapInArrow(singles, _ASK), 1)
    ask_type = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])

    def asking(words: int):
        def run(left, right):
            out = []
            for i in range(left.num_rows):
                auto = Automaton(lambda c: left.column(c)[i].as_py())
                for w in range(1, words):
                    level = auto.levels[-1]
                    level.learn(*_answered(right, w, level.key[level.order], buckets))
                    auto.deepen(known=True)
                order = auto.levels[-1].order
                out.append(pa.Table.from_batches([_ask(left.column("shard")[i].as_py(), auto.levels[-1].key[order], auto.counts(words)[order], buckets)]))
            return pa.concat_tables(out) if out else ask_type.empty_table()

        return run

    for words in range(2, most_words + 1):
        few = shards.select("shard", "keys", "tokens", "starts").groupBy("shard")
        answers = answers.unionByName(added(few.cogroup(answers.groupBy("shard")).applyInArrow(asking(words), _ASK), words))

    def scored(left, right):
        out = []
        for i in range(left.num_rows):
            auto = grown(lambda c: left.column(c)[i].as_py(), right)
            last = auto.levels[-1]
            last.learn(*_answered(right, most_words, last.key[last.order], buckets))
            out.append(_scored(auto, left.column("langs")[i].as_py(), share))
        return pa.concat_tables(out) if out else _SCORED.empty_table()

    found = written(shards.select(*needed).groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scored, _PHRASE), "phrases")
    gone = found.where("phrase is null").select("key")
    return found.where("phrase is not null").join(gone, "key", "left_anti").drop("key"), n


def mine(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, count (both descending) and phrase: lang, rank, phrase, a, l, r, n, score."""
    phrases, n = candidates(docs, most_words, least, share)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
