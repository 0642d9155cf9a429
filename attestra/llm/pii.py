"""Personal data: fixed base rules, and a semi-Markov conditional random field that adds spans.

The model scores whole candidate spans of one to seven tokens around tokens that
hold a digit, an ``@`` or a spelt-out ``(at)``; features look at the span as a
whole and at the word before it. Boundaries and types are chosen together by
dynamic programming over the tokens, however many entities a text has. Spans
that the rules found stay; a span of the model that overlaps one of them is not
added.

The weights are trained here, by the exact likelihood of segmentations, on
sentences written by a seeded generator (``examples``).

Defined cases: null text is empty and has no spans; positions count code points;
repeated rows give repeated results; a null doc_id stays null; other input
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 7

# The base patterns. Each run of characters that could open an email or an
# address is consumed whole, with or without the rest: the same matches, in linear time.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_SEED = re.compile(r"[0-9@]|[\[({](?:at|dot|AT|DOT)[\])}]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = "\"'`,;:!?<>|*#$%&=…«»“”„’"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and then start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in _EMAIL.finditer(text) if m.group(1)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if m.group(1) and all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m.group())) <= 15]
    return out


# ---- the model's view of a text ----

# Words that announce a kind, in the four languages.
_BEFORE = {
    "phone": "tel tel. phone call fax mobile cell telefon anrufen téléphone appelez portable teléfono móvil llame",
    "card": "card visa credit mastercard amex karte kreditkarte carte bancaire tarjeta",
    "ip": "ip host server gateway addr serveur servidor",
    "email": "email e-mail mail contact kontakt courriel correo contacto write",
    "other": "order invoice version isbn id no. nr. token sku page commande bestellung pedido room",
}
_ANNOUNCED = {w: k for k, ws in _BEFORE.items() for w in ws.split()}
_SHAPES = [
    ("date", re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}")),
    ("amount", re.compile(r"[$€£]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[$€£]\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?[%€£$]?")),
    ("version", re.compile(r"[vV]?\d{1,3}\.\d{1,3}(?:\.\d{1,4})?")),
    ("local", re.compile(r"\(?0?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}")),
    ("abroad", re.compile(r"00[1-9]\d{0,2}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){2,5}")),
    ("quad", re.compile(r"\d{1,3}(?:\[\.\]|\(\.\)| \. | ?\[dot\] ?| ?\(dot\) ?)\d{1,3}(?:\[\.\]|\(\.\)| \. | ?\[dot\] ?| ?\(dot\) ?)\d{1,3}(?:\[\.\]|\(\.\)| \. | ?\[dot\] ?| ?\(dot\) ?)\d{1,3}")),
    ("spelt", re.compile(r"[A-Za-z0-9._+-]+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]+(?:(?: ?[\[({](?:dot|DOT)[\])}] ?|\.)[A-Za-z0-9-]+)+")),
    ("fours", re.compile(r"\d{4}(?:[ ./-]\d{4,6}){2,4}(?:[ ./-]\d{1,3})?")),
    ("hex", re.compile(r"(?=\w*\d)(?=\w*[A-Za-z])\w+")),
]


def span_features(s: str, tokens: int, before: str) -> list[str]:
    """What is true of a whole span; ``before`` is the word that precedes it."""
    digits = re.sub(r"[^0-9]", "", s)
    n = len(digits)
    out = ["bias", f"digits{min(n, 20) if n < 4 or n > 19 else n // 2 * 2}", f"tokens{min(tokens, 4)}"]
    out += [name for name, p in _SHAPES if p.fullmatch(s)]
    if 13 <= n <= 19 and re.fullmatch(r"[0-9 ./-]+", s):
        out.append("luhn" if luhn(digits) else "noluhn")
    out.append("letters" if re.search(r"[^\W\d_]", s) else "noletters")
    if s.count("@") == 1:
        out.append("at")
    if s[0] in "([" and not s.endswith((")", "]")) and s.count("(") != s.count(")"):
        out.append("open")
    if s[-1] in ").-":
        out.append("tail")
    word = before.lower().strip(_STRIP + "().")
    out.append("before:" + _ANNOUNCED.get(word, _ANNOUNCED.get(before.lower(), "none")))
    return out


def candidates(text: str) -> tuple[list[tuple[int, int]], list[bool], list[tuple[int, int, int, int, list[str]]]]:
    """Tokens near seeds, whether each is a seed, and (first token, end token, start, end, features) of spans."""
    tokens: list[tuple[int, int]] = []
    seeds: list[bool] = []
    done = -1
    for m in _SEED.finditer(text):
        at = m.start()
        if at < done:
            continue
        a = at
        while a > 0 and not (text[a - 1] == " " or "\t" <= text[a - 1] <= "\r"):
            a -= 1
        w = _WORD.match(text, a)
        done = w.end()
        # up to five tokens on each side
        left, b = [], a
        for _ in range(MAX_TOKENS - 1):
            e = b
            while e > 0 and (text[e - 1] == " " or "\t" <= text[e - 1] <= "\r"):
                e -= 1
            b = e
            while b > 0 and not (text[b - 1] == " " or "\t" <= text[b - 1] <= "\r"):
                b -= 1
            if b == e or tokens and b <= tokens[-1][0]:
                break
            left.append((b, e))
        while tokens and tokens[-1][0] >= a:
            tokens.pop(), seeds.pop()
        tokens += left[::-1]
        seeds += [False] * len(left)
        tokens.append((a, done))
        seeds.append(True)
        at = done
        for _ in range(MAX_TOKENS - 1):
            r = _WORD.search(text, at)
            if not r:
                break
            tokens.append(r.span())
            seeds.append(False)
            at = r.end()
    spans = []
    for i in range(len(tokens)):
        start = tokens[i][0]
        while start < tokens[i][1] - 1 and text[start] in _STRIP:
            start += 1
        before = text[slice(*tokens[i - 1])] if i else ""
        some = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            if j > i and tokens[j][0] - tokens[j - 1][1] > 2:
                break  # tokens of another neighbourhood
            some |= seeds[j]
            if not some or not (seeds[i] or j > i and _opens(text, tokens, seeds, i)):
                continue
            end = tokens[j][1]
            while end > start + 1 and text[end - 1] in _STRIP + ".":
                end -= 1
            spans.append((i, j + 1, start, end, span_features(text[start:end], j + 1 - i, before)))
    return tokens, seeds, spans


def _opens(text: str, tokens: list, seeds: list, i: int) -> bool:
    """A token without digit may open a span only before a spelt-out (at)."""
    nxt = text[slice(*tokens[i + 1])].lower() if i + 1 < len(tokens) else ""
    return nxt in ("(at)", "[at]", "{at}")


def decode(spans: list[tuple[int, int, int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation; spans: first, end, start, end, kind, gain over leaving it."""
    out: list[tuple[int, int, int]] = []
    spans = sorted(s for s in spans if s[5] > 0)
    at = 0
    while at < len(spans):  # stretches of overlapping spans are independent of each other
        low, reach, stop = spans[at][0], spans[at][1], at + 1
        while stop < len(spans) and spans[stop][0] < reach:
            reach, stop = max(reach, spans[stop][1]), stop + 1
        part, at = spans[at:stop], stop
        by_end: dict[int, list] = {}
        for s in part:
            by_end.setdefault(s[1], []).append(s)
        best, back = [0.0], [None]
        for i in range(low + 1, reach + 1):
            value, last = best[-1], None
            for s in by_end.get(i, ()):
                if best[s[0] - low] + s[5] > value:
                    value, last = best[s[0] - low] + s[5], s
            best.append(value)
            back.append(last)
        i, chosen = reach, []
        while i > low:
            s = back[i - low]
            if s:
                chosen.append((s[4], s[2], s[3]))
            i = s[0] if s else i - 1
        out += chosen[::-1]
    return out


class Model:
    """Weights of (kind, feature)."""

    def __init__(self, weights: dict[tuple[int, str], float]):
        self.weights = weights

    def gain(self, kind: int, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in features)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        _, _, found = candidates(text)
        if not found:
            return []
        scored = [(i, j, a, b, k, self.gain(k, f)) for i, j, a, b, f in found for k in range(len(KINDS))]
        return decode(scored)


# ---- labelled sentences and training ----


def _card(r: random.Random, n: int, sep: str) -> str:
    d = "".join(r.choice("0123456789") for _ in range(n - 1))
    d = next(d + c for c in "0123456789" if luhn(d + c))
    return sep.join(d[i : i + 4] for i in range(0, n, 4)) if sep else d


def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with (kind, start, end) of their personal data, and look-alikes without any."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "re", "ti", "on", "le", "sch", "ung", "eau", "ció", "th", "er", "ou")) for _ in range(r.randint(1, 4)))
    name = lambda: re.sub(r"[^a-z]", "n", word()) + r.choice(("", "." + num(2), "_" + num(1)))
    tld = lambda: r.choice(("com", "org", "net", "de", "fr", "es", "co.uk"))
    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]

    def positive(k: int) -> str:
        if k == 0:
            a, d = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at@ ", ".")))
            return f"{name()}@{name()}.{tld()}" if r.random() < 0.3 or "@" in a else f"{name()}{a}{re.sub('[^a-z]', 'x', word())}{d}{tld().split('.')[0]}"
        if k == 1:
            return r.choice((".", "[.]", "(.)", " . ", "[dot]")).join(octets())
        if k == 2:
            return _card(r, r.choice((13, 14, 15, 16, 16, 16, 18, 19)), r.choice(("", " ", "-", ".")))
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{r.randint(1, 9)}{num(1)} {num(3)} {num(4)}", f"+{r.randint(1, 9)} ({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"))

    def negative() -> str:
        return r.choice((num(r.randint(1, 7)), f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", hashlib.md5(num(5).encode()).hexdigest(), "sk" + hashlib.md5(num(5).encode()).hexdigest()[:20], f"{r.randint(1, 9)},{num(3)},{num(3)}", f"${num(3)}", f"{num(2)}%", f"{num(4)} {num(4)}", f"{num(r.randint(8, 12))}", "@" + word(), f"{num(3)} {num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", _spoilt(_card(r, 16, r.choice(("", " ", "-"))))))

    def _spoilt(card: str) -> str:
        return card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(0, 5))) + " "
            text = text.lstrip()
            x = r.random()
            if x < 0.55:
                k = r.randrange(4)
                if r.random() < 0.4:
                    text += r.choice(_BEFORE[KINDS[k]].split()) + r.choice((" ", ": "))
                v = positive(k)
                spans.append((k, len(text), len(text) + len(v)))
                text += v + r.choice((" ", ", ", ". "))
            elif x < 0.9:
                if r.random() < 0.4:
                    text += r.choice(_BEFORE["other"].split()) + " "
                text += negative() + r.choice((" ", ", ", ". "))
        out.append((text, spans))
    return out


def train(n: int = 900, rounds: int = 6, seed: int = 11) -> Model:
    """Stochastic gradient on the log likelihood of each sentence's segmentation (forward-backward over spans)."""
    data = []
    for text, gold in examples(n, seed):
        tokens, _, found = candidates(text)
        want = {(k, a, b) for k, a, b in gold}
        data.append((len(tokens), [(i, j, f, [(k, a, b) in want for k in range(4)]) for i, j, a, b, f in found]))
    w: dict[tuple[int, str], float] = {}
    order = random.Random(seed)
    for turn in range(rounds):
        order.shuffle(data)
        rate = 0.5 / (1 + turn)
        for size, spans in data:
            score = [[sum(w.get((k, f), 0.0) for f in fs) for k in range(4)] for _, _, fs, _ in spans]
            forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
            ends, starts = [[] for _ in range(size + 1)], [[] for _ in range(size + 1)]
            for s, (i, j, _, _) in enumerate(spans):
                ends[j].append(s)
                starts[i].append(s)
            for i in range(1, size + 1):
                v = [forward[i - 1], *(forward[spans[s][0]] + x for s in ends[i] for x in score[s])]
                top = max(v)
                forward[i] = top + math.log(sum(math.exp(x - top) for x in v))
            for i in range(size - 1, -1, -1):
                v = [backward[i + 1], *(backward[spans[s][1]] + x for s in starts[i] for x in score[s])]
                top = max(v)
                backward[i] = top + math.log(sum(math.exp(x - top) for x in v))
            for s, (i, j, fs, gold) in enumerate(spans):
                for k in range(4):
                    g = gold[k] - math.exp(forward[i] + score[s][k] + backward[j] - forward[size])
                    if abs(g) > 1e-4:
                        for f in fs:
                            w[k, f] = w.get((k, f), 0.0) * (1 - 1e-4) + rate * g
    return Model(w)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), each by kind and start."""
    base = base_spans(text)
    if not _SEED.search(text):
        return base, sorted(base)
    order = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in order], list(accumulate((b for _, b in order), max))  # of all that start up to there, the last end
    free = lambda a, b: not (n := bisect_left(starts, b)) or ends[n - 1] <= a
    return base, sorted(base + [s for s in model.spans(text) if free(s[1], s[2])])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each maximal covered stretch becomes the name of the kind that opens it, in angle brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, redacted (text)."""
    weights = (model or train()).weights
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Model(weights)
        for piece in T.slices(batches, "text"):
            rows = []
            for text in piece.column("text").to_pylist():
                base, spans = all_spans(text or "", crf)
                n = [0, 0, 0, 0]
                for s in base:
                    n[s[0]] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans) if spans else text))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))], schema=schema)

    out = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with all its columns and rows; personal data in ``text`` is replaced by its kind, and ``n_chars`` (where there is such a column) follows."""
    weights = (model or train()).weights
    n_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Model(weights)
        for piece in T.slices(batches, "text"):
            texts, changed = piece.column("text").to_pylist(), {}
            for i, text in enumerate(texts):
                if text and (spans := all_spans(text, crf)[1]):
                    changed[i] = texts[i] = redacted(text, spans)
            if changed:
                cols, names = list(piece.columns), piece.schema.names
                at = names.index("text")
                cols[at] = pa.array(texts, cols[at].type)
                if n_chars:
                    at = names.index("n_chars")
                    old = cols[at].to_pylist()
                    cols[at] = pa.array([len(texts[i]) if i in changed else x for i, x in enumerate(old)], cols[at].type)
                piece = pa.RecordBatch.from_arrays(cols, schema=piece.schema)
            yield piece

    return docs.mapInArrow(run, docs.schema)
