"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding: the one whose
predecessor (the last token of the shorter prefix) is compatible with it, which
means that the two stay apart when their symbols are encoded together. An
automaton over the vocabulary yields the tokens that end at each position; the
pair test walks down both tokens' merge trees. Back-pointers then give the ids.

The vocabulary has word ends: the last symbol of a word is a symbol of its own.
Text goes through NFC, white space and lower-casing as the vocabulary's file
states; special tokens that occur in a text become their ids.

Defined cases: null text is empty and has no ids; null doc_id is kept as it is;
repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T

_END = 0x10000  # added to a symbol's code point where it ends a word
_CACHE, _CACHED_WORD = 400_000, 64  # words, and the longest of them


def _byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: themselves where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(more)) for b in range(256)]


class Bpe:
    """Encoder of one vocabulary; built once in each Python worker."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.bytes = _byte_symbols()
        inner = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + _END) if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self.join: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            c, pair = self.vocab[a + b], (self.vocab[a], self.vocab[b])
            self.join.setdefault(pair, (r, c))
            if c not in self.parts:
                self.parts[c], self.rank[c] = pair, r
        symbols = {t: inner(t) for t in self.vocab}
        self.base = {s: self.vocab[t] for t, s in symbols.items() if len(s) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, s in symbols.items():
            if len(s) == 1 or self.vocab[t] in self.parts and self.merged(s) == [self.vocab[t]]:
                self.automaton.add_word(s, (len(s), self.vocab[t]))
        self.automaton.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def merged(self, symbols: str) -> list[int]:
        """Plain merging by rank; it only decides which tokens can stand alone."""
        ids = [self.base[s] for s in symbols]
        while len(ids) > 1:
            found = [(self.join[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.join]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.join[ids[i], ids[i + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the border of the two comes before the merges that build them."""
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # undo the later of the two tokens' last merges, looking for a merge over the border that would have come first
        limit = len(self.rank) + len(self.join) + 1
        while True:
            over = self.join.get((a, b))
            if over is not None and over[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:  # of equal ranks the left one is made first
                limit, b = rb + 1, self.parts[b][0]

    def word(self, word: str) -> bytes:
        """Ids of one word, as little-endian unsigned 32-bit integers."""
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] = chr(ord(symbols[-1]) + _END)
        n = len(symbols)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, found in self.automaton.iter("".join(symbols)):
            ends[at].append(found)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for i in range(n):
            for k, t in sorted(ends[i], reverse=True):
                before = last[i + 1 - k]
                if k == i + 1 or before >= 0 and self.compatible(before, t):
                    last[i + 1], size[i + 1] = t, k
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
                continue
            piece = self.space.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ").lower()
            for w in self.split.findall(piece):
                got = self.cache.get(w)
                if got is None:
                    if len(self.cache) >= _CACHE:
                        self.cache.clear()
                        self.apart.clear()
                    got = self.word(w)
                    if len(w) <= _CACHED_WORD:
                        self.cache[w] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ready: dict[str, Bpe] = {}


def _codec(key: str, spec) -> Bpe:
    if key not in _ready:
        _ready.clear()
        _ready[key] = Bpe(json.loads(spec.value))
    return _ready[key]


def encode(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_text`` also ids (array) and decoded."""
    raw = open(path, encoding="utf-8").read()  # noqa: SIM115  of a fixed vocabulary: a few MB
    key, spec = hashlib.sha256(raw.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(raw)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _codec(key, spec)
        for piece in T.slices(batches, "text"):
            ids = [bpe.encode(t or "") for t in piece.column("text").to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            cols = [piece.column("doc_id"), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
            cols += [[np.frombuffer(x, "<u4").tolist() for x in ids], texts] if keep_text else []
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)
