"""Spelling variants: words of a corpus that differ by one code point, grouped
under their frequent forms.

The vocabulary is composed with a one-edit transducer and with itself again:
acceptor - edit - acceptor. The composition is enumerated by its initial
states. An edit leaves the first or the last half of the longer word as it is,
so each pair is accepted from the state that the shared first half leads to, or
backwards from that of the shared last half; a word goes to the partitions of
the (three) halves that it can share. A partition holds what is between its
fixed beginning and end; its minimal acceptor is built and composed in a task,
which puts out one row a word: the number of near words and the best of them.
The canonical place of the edit (``acceptor.one_edit_pairs``) lies in one
partition only, so nothing is counted twice.

A partition of more than ``LARGE`` words is split exactly: an edit beyond the
next symbols lies in the partition of the beginning that is longer by them; one
at a symbol shares all that follows it. Both are partitions of the same kind.

Words are counted in the tasks that read the texts, and added up. Null texts
have no words; a null id counts as an empty one; each row counts, also a repeated
one. Other columns are not looked at. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.acceptor import Acceptor, one_edit_pairs
from chatlens.llm.common import UPPER, keep_table

SHORTEST = 5            # code points of a word, at least
OFTEN = 3               # times that it must occur
TIMES = 2               # a form is so many times as frequent
SLIP = 97               # one run in so many loses a code point
LARGE = 20_000          # words of a partition that is not split
HELD = 1 << 18          # words that a task counts before it puts them out

_RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of whole texts. Tasks count by text and then by
    word before anything is shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            rows = [(w, n) for w, n in held.items() if len(w) >= SHORTEST]
            held.clear()
            return pd.DataFrame(rows, columns=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                own: Counter[str] = Counter()
                for w, n in Counter(_RUN.findall(text or "")).items():
                    own[w.lower() if w.isascii() else w.translate(_LOWER)] += n
                begin = zlib.crc32(f"{doc_id}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), begin)
                    if h % SLIP == 0:
                        w = w[:h % len(w)] + w[h % len(w) + 1:]
                    held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
                        docs[text_col].cast("string").alias("text"))
    return (texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= OFTEN))


def _place(begin: Column, end: Column, least: Column) -> Column:
    """A partition: words that start with ``begin`` (their first ``a`` code
    points) and end with ``end``; pairs whose longer word has ``least`` code
    points or more belong to it."""
    return F.struct(F.concat_ws("/", begin, end, least.cast("string")).alias("key"),
                    F.length(begin).alias("a"), F.length(end).alias("b"), least.cast("int").alias("least"))


def _halves(words: DataFrame) -> DataFrame:
    w, size = F.col("word"), F.length("word")
    none = F.lit("")

    def first(m):               # longer words of 2 m and 2 m + 1 code points
        return _place(F.left(w, m), none, 2 * m)

    def last(s):                # longer words of 2 s - 1 and 2 s
        return _place(none, F.right(w, s), 2 * s - 1)

    low, high = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
    places = F.array_distinct(F.array(first(low), first(high), last(high), last(F.floor(size / 2).cast("int") + 1)))
    return words.select("word", "n", F.explode(places).alias("place")).select("word", "n", "place.*")


def _finer(rows: DataFrame, reach: int) -> DataFrame:
    """Rows of large partitions in smaller ones: their beginnings longer by
    ``reach`` symbols, and one partition for what follows each of these."""
    w, size, a, b = F.col("word"), F.length("word"), F.col("a"), F.col("b")
    inner = size - a - b

    def around(p, q):           # first p and last q code points are fixed
        return _place(F.left(w, p), F.right(w, q), F.col("least"))

    places = [F.when(inner >= reach, around(a + reach, b))]
    for k in range(reach):      # the edit is at place a + k of the longer word
        places += [F.when(inner > k, around(a + k, size - a - k - 1)),      # which has a symbol there
                   F.when(inner >= k, around(a + k, size - a - k))]         # the shorter one has not
    return (rows.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("place"))
            .select("word", "n", "place.*"))


def partitions(words: DataFrame, large: int = LARGE) -> DataFrame:
    """Rows (word, n, key, a, b, least) of the partitions of two words and more,
    each of ``large`` words at most or of words that differ in one place only
    (not more than there are letters)."""
    rows, done, reach = keep_table(_halves(words), "spelling-places"), None, 1
    while True:
        sizes = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                         F.max(F.length("word") - F.col("a") - F.col("b")).alias("inner"))
                 .filter("size > 1").withColumn("split", (F.col("size") > large) & (F.col("inner") > 1)))
        split = keep_table(sizes.filter("split").select("key"), "spelling-large")
        some = rows.join(sizes.filter("not split").select("key"), "key", "left_semi")
        done = some if done is None else done.unionByName(some)
        if split.isEmpty():
            return done
        rows = keep_table(_finer(rows.join(split, "key", "left_semi"), reach), "spelling-places")
        reach = min(2 * reach, 16)


def _compose(words: list[str], counts: list[int], a: int, b: int, least: int) -> list[tuple]:
    """(word, near words, best count, best word) of a partition."""
    begin, end = words[0][:a], words[0][len(words[0]) - b:]
    inner = {w[a:len(w) - b]: n for w, n in zip(words, counts, strict=True)}
    near: dict[str, list] = {}
    for u, v in one_edit_pairs(Acceptor(sorted(inner)), end):
        if len(v) + a + b >= least:
            for x, y in ((u, v), (v, u)):
                row = near.setdefault(x, [0, 0, ""])
                row[0] += 1
                if (-inner[y], y + end) < (-row[1], row[2]):
                    row[1:] = inner[y], y + end
    return [(begin + x + end, k, n, begin + y) for x, (k, n, y) in near.items()]


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n_near, best_n and best (of the near words the most frequent one,
    of equals the least)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[tuple] = []

        def close() -> list[tuple]:
            _, _, _, a, b, least = open_[0]
            return _compose([r[0] for r in open_], [r[1] for r in open_], a, b, least)

        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(batch[c].tolist() for c in ("word", "n", "key", "a", "b", "least")), strict=True):
                if open_ and open_[0][2] != r[2]:
                    out += close()
                    open_ = []
                open_.append(r)
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
        if open_:
            yield pd.DataFrame(close(), columns=["word", "n_near", "best_n", "best"])

    found = (partitions(words, large).select("word", "n", "key", "a", "b", "least")
             .repartition("key").sortWithinPartitions("key")
             .mapInPandas(run, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("best_n"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
            .select("word", "n_near", (-F.col("x.best_n")).alias("best_n"), F.col("x.best").alias("best")))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent
    near word (ties: the least), if that is ``TIMES`` times as frequent or more,
    else null; its root is the last of the forms' forms, or itself."""
    words = keep_table(vocabulary(docs, id_col, text_col), "spelling-words")
    near = words.join(near_words(words, large), "word", "left")
    has = F.col("best_n") >= TIMES * F.col("n")
    rows = keep_table(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-near")
    # counts double from form to form, so ways are short; each round doubles the step
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        over = roots.select(F.col("word").alias("root"), F.col("root").alias("over"))
        roots = keep_table(roots.join(over, "root", "left").select("word", F.coalesce("over", "root").alias("root"),
                                                                  F.col("over").isNotNull().alias("moved")),
                           "spelling-roots")
        moved = not roots.filter("moved").isEmpty()
        roots = roots.select("word", "root")
        if not moved:
            break
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
