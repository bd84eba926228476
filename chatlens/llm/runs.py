"""Runs (maximal repetitions) of words in whole texts, and texts without them.

A run is a stretch of words with smallest period q, so that words q apart are
the same, of at least ``LEAST`` words and ``TIMES`` periods, that no
neighbouring word extends. They are found with a suffix automaton and link-cut
access to its tree of suffix links (``find_runs``):

* the states on the way from the root to the state of the prefix that ends at
  word i stand for all suffixes of that prefix. Each state is coloured with the
  last place at which it ended. Access to the state makes the way one path of
  the link-cut trees and gives it the colour i; the paths that it is put
  together from are segments of suffixes, by their length, that all ended last
  at the same place e;
* a segment of the lengths (lo, hi] with p = i - e in it says that the last p
  words were there p words before, too: a square of period p, which is the
  smallest, as the stretch of p words did not end in between. The words before
  it agree as far as hi, so the period reaches over the last hi + p words;
* the run ends at i if word i + 1 differs from word i + 1 - p.

Only stretches that can hold a run are given to the automaton: within a run
each stretch of ``GRAM`` words is met again in the text (whatever the period),
so words that no such repeated stretch covers lie in no run.

A text is worked on by itself: the rows are spread as they are read, nothing is
shuffled. Null and empty texts have no words and no runs. Equal rows give equal
results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 24              # words of a run, at least
TIMES = 3               # periods of a run, at least
GRAM = 8                # see below

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# A gram of k words in a run of period q and n >= max(LEAST, TIMES * q) words is
# met again, q words on or back, unless n < 2 q + k - 1. For k <= q + 1 the
# right side is at most 3 q; for k > q + 1 it is at most 3 k - 5 <= LEAST for
# k <= 9.


def suffix_links(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``word``: length and suffix link of each state,
    and the state of each prefix."""
    step: list[dict[int, int]] = [{}]
    length, link, prefix = [0], [-1], []
    last = 0
    for i, c in enumerate(word):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        prefix.append(now)
        last = now
    return length, link, prefix


class LastEnds:
    """Link-cut trees over a fixed tree; each preferred path has one colour.

    ``access(x, i)`` gives the coloured segments of the way from x to the root
    as (depth of the deepest state, colour), deepest first, and colours the way
    with i. The splay trees are ordered by depth; the colour of a path is kept
    at the root of its splay tree."""

    def __init__(self, length: list[int], link: list[int]):
        n = len(link)
        self.length = length
        self.up = list(link)            # parent in the splay tree, or the path's parent
        self.left, self.right = [-1] * n, [-1] * n
        self.colour = [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b >= 0:
            up[b] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z < 0 or (left[z] != y and right[z] != y):       # y is the root: its colour moves up
                self.colour[x] = self.colour[y]
                self._rotate(x)
                return
            if left[z] == y and left[y] == x or right[z] == y and right[y] == x:
                top, low = y, x
            else:
                top, low = x, x
            w = up[z]
            if w < 0 or (left[w] != z and right[w] != z):
                self.colour[x] = self.colour[z]
            self._rotate(top)
            self._rotate(low)

    def access(self, x: int, i: int) -> list[tuple[int, int]]:
        found = []
        below, at = -1, x
        while at >= 0:
            self._splay(at)
            if self.colour[at] >= 0:
                found.append((self.length[at], self.colour[at]))
            deeper = self.right[at]
            if deeper >= 0:             # the part below is a path of its own now
                self.colour[deeper] = self.colour[at]
            self.right[at] = below
            below, at = at, self.up[at]
        self.colour[below] = i          # the splay tree of the whole way
        return found


def find_runs(word: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``word``, in any order."""
    length, link, prefix = suffix_links(word)
    ends = LastEnds(length, link)
    n, out = len(word), []
    for i in range(n):
        found = ends.access(prefix[i], i)
        for k, (hi, e) in enumerate(found):
            p = i - e
            if p > hi or hi + p < least or hi + p < times * p:
                continue
            lo = found[k + 1][0] if k + 1 < len(found) else 0
            if lo < p and (i + 1 == n or word[i + 1] != word[i + 1 - p]):
                out.append((i + 1 - hi - p, hi + p, p))
    return out


def stretches(word: np.ndarray, least: int = LEAST, gram: int = GRAM) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that repeated grams cover."""
    n = len(word)
    if n < least:
        return []
    key = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k:n - gram + 1 + k].astype(np.uint64)
        key ^= key >> np.uint64(29)
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.zeros(len(key) + 2, np.int8)
    again[1:-1] = counts[back] > 1
    turns = np.diff(again)
    return [(a, b + gram - 1) for a, b in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(),
                                              strict=True) if b + gram - 1 - a >= least]


def runs_of(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, period."""
    if len(words) < least:
        return []
    gram = GRAM if least >= LEAST and times >= TIMES else 1
    ids: dict[str, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    out = []
    for a, b in stretches(word, least, gram):
        out += [(a + s, n, p) for s, n, p in find_runs(word[a:b].tolist(), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    gone = np.cumsum(turn[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def looped(doc_id: int | None, words: list[str]) -> list[str]:
    """A tenth of the documents, by a hash of the id, get a periodic end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
           times: int = TIMES, plant: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and
    collapsed (the text without what runs repeat, its words joined by one
    space). ``plant`` repeats the ends of some documents first (``looped``)."""
    schema = T.StructType([T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])

    @F.pandas_udf(schema)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            runs, kept = [], []
            for i, text in zip(ids, texts, strict=True):
                words = _WORD.findall(text or "")
                if plant:
                    words = looped(None if i is None else int(i), words)
                own = runs_of(words, least, times)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                kept.append(" ".join(without(words, own)))
            yield pd.DataFrame({"runs": runs, "collapsed": kept})

    number = docs[id_col].cast("string")        # a null id stays null
    return (docs.select(docs[id_col].alias("doc_id"), found(number, docs[text_col].cast("string")).alias("f"))
            .select("doc_id", "f.runs", "f.collapsed"))


def report(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests, of ``detect``'s rows."""
    def better(a, b):
        x, y = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a["period"].isNull() | (x > y), b).otherwise(a)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                      r["period"].cast("string")))
    return (found.withColumn("best", F.aggregate("runs", none, better))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
                    .alias("runs_sha256"),
                    F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")))
