"""Sequence similarity (matching blocks) as an Arrow-batched UDF, for distinct pairs."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST


@F.pandas_udf(ST.DoubleType())
def ratio(expected: pd.Series, detected: pd.Series) -> pd.Series:
    """2 M / T over matching blocks; the order of the arguments matters."""
    out = [2.0 * covered(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in zip(expected, detected, strict=True)]
    return pd.Series(out, dtype="float64")


def scored_pairs(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """``pairs`` with the ratio of two columns; equal pairs are computed once, and equal values not at all."""
    distinct = pairs.select(a, b).where(F.col(a) != F.col(b)).distinct().withColumn(out, ratio(F.col(a), F.col(b)))
    left = pairs.join(distinct, [a, b], "left")
    return left.withColumn(out, F.when(F.col(a) == F.col(b), F.when(F.col(a) == "", 0.0).otherwise(1.0)).otherwise(F.coalesce(out, F.lit(0.0))))


def covered(a: str, b: str) -> int:
    """Characters in the matching blocks of two strings: the longest common run, the first in ``a`` and then in ``b`` among equals, and the same on both sides of it."""
    if len(b) >= 200:  # from there on SequenceMatcher leaves frequent letters out
        return sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())
    total, todo, find = 0, [(0, len(a), 0, len(b))], b.find
    while todo:
        at, a_end, low, high = todo.pop()
        size, most, first = 0, high - low, at
        i = at
        while i + size < a_end and size < most:
            while i + size < a_end and size < most and find(a[i : i + size + 1], low, high) >= 0:
                size, first = size + 1, i
            i += 1
        if size:
            total += size
            j = find(a[first : first + size], low, high)
            if at < first and low < j:
                todo.append((at, first, low, j))
            if first + size < a_end and j + size < high:
                todo.append((first + size, a_end, j + size, high))
    return total


class Forms:
    """Slices of one string, as forms to be compared with many targets, each of which has some of ``letters``."""

    def __init__(self, whole: str, start: np.ndarray, end: np.ndarray, letters: set[str]):
        self.whole, self.start, self.end, self.size = whole, start, end, np.maximum(end - start, 0)
        self.point = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.rows = {c: n % 128 for n, c in enumerate(sorted(letters))}  # letters that share a row only loosen the limit
        self.has = np.zeros((min(len(letters), 128), len(start)), np.int32)
        for c, row in self.rows.items():
            self.has[row] += self._inside(self.point == ord(c))

    def _inside(self, marked: np.ndarray) -> np.ndarray:
        """How many marked characters each slice has."""
        upto = np.zeros(len(marked) + 1, np.int32)
        np.cumsum(marked, out=upto[1:])
        return upto[self.start + self.size] - upto[self.start]

    def marked(self, asks) -> np.ndarray:
        """How many characters each slice has that ``asks`` is true of."""
        return self._inside(np.isin(self.point, [ord(c) for c in set(self.whole) if asks(c)]))

    def best(self, targets: list[tuple[str, np.ndarray]], least: float, count: int, slack: float, always: float) -> list[tuple[list[tuple[int, float]], int]]:
        """For each target and the forms allowed for it: (place, ratio) of every form whose ratio is at least ``least`` and no more than ``slack`` under the ``count``-th best of different forms, or at least ``always``; and how many forms have letters enough for that.

        Forms are tried in order of an upper limit, the letters that they share with the target in any order, and of some of them
        at once in order of a nearer one, their longest common subsequence. So the ratio itself is computed for few. Sixteen targets go together.
        """
        if len(targets) > 16:
            return [x for at in range(0, len(targets), 16) for x in self.best(targets[at : at + 16], least, count, slack, always)]
        plans = [self._tried(target, allowed, least) for target, allowed in targets]
        done, floors, tops, seen, out = [0] * len(targets), [least] * len(targets), [[] for _ in targets], [{} for _ in targets], [[] for _ in targets]
        todo = list(range(len(targets)))
        while todo:
            some = []
            for k in todo:
                upto = min(done[k] + (512 if done[k] else 4 * count), int(np.searchsorted(-plans[k][1], 1e-9 - floors[k], "right")))
                some.append(plans[k][0][done[k] : upto])
                done[k] = max(upto, done[k])
            for k, rows, common in zip(todo, some, self.common_at_most([targets[k][0] for k in todo], some), strict=True):
                target, top, floor, values = targets[k][0], tops[k], floors[k], seen[k]
                m = len(target)
                nearer = 2 * common / (self.size[rows] + m)
                order = np.argsort(-nearer, kind="stable")
                rows = rows[order]
                for place, at, to, most in zip(rows.tolist(), self.start[rows].tolist(), self.end[rows].tolist(), nearer[order].tolist(), strict=True):
                    if most < floor - 1e-9:
                        break
                    text = self.whole[at:to]
                    value, new = values.get(text), text not in values
                    if new:
                        value = values[text] = 1.0 if text == target else 2.0 * covered(target, text) / (to - at + m)
                    if value >= floor:
                        out[k].append((place, value))
                        if new:
                            (heapq.heappush if len(top) < count else heapq.heappushpop)(top, value)
                            if len(top) == count:
                                floor = max(least, min(top[0] - slack, always))
                floors[k] = floor
            todo = [k for k in todo if done[k] < len(plans[k][1]) and plans[k][1][done[k]] >= floors[k] - 1e-9]
        return [([x for x in out[k] if x[1] >= floors[k]], int(np.count_nonzero(plans[k][1] >= floors[k] - 1e-9))) for k in range(len(targets))]

    def _tried(self, target: str, allowed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Forms that can reach ``least``, and the limits of their ratios, the highest first."""
        m, want = len(target), {}
        for c in target:
            want[self.rows[c]] = want.get(self.rows[c], 0) + 1
        shared = np.minimum(self.has[list(want)], np.array(list(want.values()), np.int32)[:, None]).sum(0)
        limit = 2 * np.minimum(shared, self.size) / np.maximum(self.size + m, 1)
        rows = np.flatnonzero(allowed & (self.size > 0) & (limit >= least - 1e-9))
        rows = rows[np.argsort(-limit[rows], kind="stable")]
        return rows, limit[rows]

    def common_at_most(self, targets: list[str], rows: list[np.ndarray]) -> list[np.ndarray]:
        """Longest common subsequence of each target with its ``rows``, an upper limit of what matching blocks can cover; one bit for each letter of the target, all rows at once."""
        every, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        order = np.argsort(-self.size[every], kind="stable")
        size, out = self.size[every][order], np.zeros(len(every), np.int64)
        start = (self.start[every] + of * len(self.point))[order]
        ends = len(every) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
        for w in range(0, max(map(len, targets)), 62):  # of a long target the parts' limits add up
            masks, full = np.zeros((len(targets), len(self.point)), np.uint64), []
            for k, target in enumerate(targets):
                part = target[w : w + 62]
                full.append((1 << len(part)) - 1)
                for c in set(part):
                    masks[k, self.point == ord(c)] = sum(1 << i for i, x in enumerate(part) if x == c)
            whole, masks = np.array(full, np.uint64)[of[order]], masks.ravel()
            left, hit, more = whole.copy(), np.empty_like(whole), np.empty_like(whole)
            for j, n in enumerate(ends.tolist()):
                now, h, m = left[:n], hit[:n], more[:n]
                np.bitwise_and(now, masks[start[:n]], out=h)
                np.add(now, h, out=m)
                np.bitwise_xor(now, h, out=now)
                np.bitwise_or(now, m, out=now)
                start[:n] += 1
            start -= size
            out[order] += (np.bitwise_count(whole) - np.bitwise_count(left & whole)).astype(np.int64)
        return np.split(out, np.cumsum([len(x) for x in rows])[:-1])
