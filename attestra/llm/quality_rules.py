"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds the ratio of two counts of a text, in hundredths: it fails a text whose
``part`` is under ``least`` or over ``most`` hundredths of ``whole``. All arithmetic
is in whole numbers. The counts of a text:

    n_words         words, maximal runs of other than the characters 20 and 09 to 0D
    word_chars      code points in words
    n_symbols       characters of # * $ % & | < >
    n_marks         characters of ! ?
    n_dots          pairs of dots and ellipsis signs
    n_stop_words    parts between these blanks and , . ; : ! ? that are one of STOP_WORDS once lower-cased
    n_lines         lines, cut at line feeds, that have a word
    n_dup_lines     such lines that equal an earlier one
    n_bullets       such lines that begin with - * or a bullet sign
    n_repeat_words  words in windows of five words that the text has twice or more, the first included
    one             1, for bounds of a count itself

Base rules are the two that BASE holds; ``kept`` needs these and all of RULES to hold.
The work is linear in a text but for the sort of its windows, which only texts with
a repeated window need; windows are told apart by 64-bit hashes within one text.
There is no shuffle and no state: a hot source or a group of copies costs what its
rows cost.

Defined cases: a null or empty text, or one of white space, has no words and fails the
base rules; a null doc_id stays null; repeated rows get a row each; an empty table gives
an empty one; other columns are kept by ``apply``, and those with the name of a count are
replaced by it. A ratio whose ``whole`` is 0 fails only where ``part`` is above 0 and has an
upper bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
_BLANK = r"[\x20\x09-\x0D]"
#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = tuple(
    "the be to of and that have with is in it for was on are as by this from or an at not "
    "le la les de du des et un une en est que qui dans pour sur par au aux avec il elle ne pas "
    "el los las y una del al se con su lo como es no para "
    "der die das und ist ein eine den dem von zu mit auf für im nicht sich als auch".split()
)


class Rule(NamedTuple):
    """Fails a text where ``part`` is under ``least`` or over ``most`` hundredths of ``whole``; ``spare`` is taken off ``whole`` first, so that the lower bound spares short texts."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    spare: int = 0


BASE = (
    Rule("few_words", "n_words", "one", least=1_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=20),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=2_000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "n_words", most=30),
    Rule("dots", "n_dots", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=4, spare=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=60),
    Rule("bullets", "n_bullets", "n_lines", most=90),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_BLANK}+"), "")


def _repeats(w: Column) -> Column:
    """Words in windows that occur twice or more."""
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    keys = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def positions(k: Column) -> Column:
        ranked = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(bound(ranked, lambda s: F.filter(s, lambda x, j: same(s, x, j))), lambda x: x["i"]))

    def covered(k: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(positions(k), start, add, lambda a: a["n"])

    return bound(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))


def _counts(text: Column, stop_words: Iterable[str]) -> dict[str, Callable[[Column, Column], Column]]:
    """Each count as a function of a text's words and its lines with a word."""
    stop = sorted(stop_words)
    return {
        "n_words": lambda w, lines: F.size(w),
        "word_chars": lambda w, lines: F.char_length(text) - F.regexp_count(text, F.lit(_BLANK)),
        "n_symbols": lambda w, lines: F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_marks": lambda w, lines: F.regexp_count(text, F.lit("[!?]")),
        "n_dots": lambda w, lines: F.regexp_count(text, F.lit(r"\.\.|…")),
        "n_stop_words": lambda w, lines: F.size(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D,.;:!?]+"), lambda x: x.isin(stop))),
        "n_lines": lambda w, lines: F.size(lines),
        "n_dup_lines": lambda w, lines: F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullets": lambda w, lines: F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_repeat_words": lambda w, lines: _repeats(w),
        "one": lambda w, lines: F.lit(1),
    }


def counts(text: Column, names: Iterable[str], stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """A struct of the named counts of a text, each a long."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    made = _counts(text, stop_words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(words(text), lambda w: bound(lines, lambda at: F.struct(*(made[n](w, at).cast("long").alias(n) for n in dict.fromkeys(names)))))


def fails(rule: Rule, m: Callable[[str], Column]) -> Column:
    """Whether a text with these counts breaks a rule."""
    part, whole = 100 * m(rule.part), m(rule.whole)
    low = [part < rule.least * (whole - rule.spare)] if rule.least is not None else []
    high = [part > rule.most * whole] if rule.most is not None else []
    out = F.lit(False)
    for c in low + high:
        out = out | c
    return out


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply(docs: DataFrame, rules: Iterable[Rule] = RULES, base: Iterable[Rule] = BASE) -> DataFrame:
    """The rows of ``docs`` with the counts, ``base_failed``, ``failed`` (names of the broken rules, in the order of the tables) and ``kept``."""
    rules, base = tuple(rules), tuple(base)
    needed = [*REPORTED, *(c for r in (*base, *rules) for c in (r.part, r.whole))]
    shown = [c for c in dict.fromkeys(needed) if c != "one"]
    own = {c.lower() for c in (*shown, "base_failed", "failed", "kept", "attestra_counts")}
    kept = [c for c in docs.columns if c.lower() not in own]
    m = lambda c: F.lit(1).cast("long") if c == "one" else F.col("attestra_counts")[c]
    counted = docs.select(*kept, counts(F.col("text"), shown).alias("attestra_counts"))
    any_of = lambda table: F.greatest(F.lit(False), F.lit(False), *(fails(r, m) for r in table))
    broken = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(fails(r, m), F.lit(r.name)) for r in (*base, *rules))))
    return counted.select(*kept, *(m(c).alias(c) for c in shown), any_of(base).alias("base_failed"), broken.alias("failed"), (~any_of((*base, *rules))).alias("kept"))
