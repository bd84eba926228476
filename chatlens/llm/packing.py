"""Packing of token ids into sequences of a fixed length, with little padding.

1. One pass over the texts gives each document its ids (the tokeniser's, then
   an end id) and a random group; the table is kept in the shared folder, so
   groups and ids are the same however often a task is run again.
2. Each group is packed by itself. Whole stretches of ``length`` ids of a long
   document are sequences of their own. What is left of the documents goes, the
   longest first, into the first sequence with room (first-fit decreasing); the
   leaves of a tournament tree hold the sequences' room, each inner node the
   larger of its two, so the first that fits is found on one way down.
3. Room that first-fit leaves is filled with ids of the emptiest sequence,
   whose pieces are cut for it. The one sequence of the group that stays short
   falls into sequences whose lengths are powers of two, which need no padding.

A group holds about ``group`` documents, whatever the size of the table, and
no group knows of another. Null and empty texts are documents of the end id
only. Each row is a document, also rows with the same id or a null id. Other
columns are not looked at. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import keep_table
from chatlens.llm.token_counts import tokenizer

LENGTH = 2048           # ids of a sequence
GROUP = 2048            # documents of a group, about
KNOWN = 1 << 18         # words whose ids a task remembers
BATCH = 256             # words that are encoded at once

_SPACES = re.compile(r"[\x20\x09-\x0D]+")

# The kind of tokeniser whose work is done in two quick steps, see Encoder: its
# normaliser and its words.
_NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = 0x180           # characters below it: composed, and the same in every edition of Unicode
END = "\x01"            # stands for a word's end; texts that have it go the other way


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_WHITE}{_class('LN')}]+")
_NOT_PLAIN = re.compile(f"[{END}{chr(PLAIN)}-\U0010ffff]|<\\|")


@functools.cache
def _quick(path: str):
    """The tokeniser's merges for ``tiktoken``, or None if it is of another
    kind. A word's end is a byte of its own there, which the lowest ranks join
    to the last byte, so words are merged in the same order."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model = given["model"]
    split = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern")
    if (given["normalizer"] != _NORMALISER or split != {"Regex": _SPLIT} or model["type"] != "BPE"
            or model["end_of_word_suffix"] != "</w>"):
        return None
    import tiktoken

    printed = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b < 128 or b > 160 and b != 173]
    byte = {chr(b): b for b in printed}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    special = {t["content"] for t in given["added_tokens"]}
    ranks = {}
    for token, rank in model["vocab"].items():
        if token not in special:
            end = token.endswith("</w>") and len(token) > 4
            ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + (END.encode() if end else b"")] = rank
    return tiktoken.Encoding(path, pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian numbers of ``width`` bytes.

    Only for tokenisers whose tokens never hold or reach over white space and
    whose normaliser looks at nothing beyond it: there a text's ids are those
    of its words in turn, so each word is encoded once and remembered. Texts of
    plain characters (``PLAIN``) are normalised and cut into words here and
    merged by a quicker library, where the tokeniser is of the known kind."""

    def __init__(self, path: str, known: int = KNOWN):
        self.tok = tokenizer(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.ids: dict[str, bytes] = {}
        self.known = known
        self.quick = _quick(path)

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.quick is None or _NOT_PLAIN.search(text):
            return self.by_word(text)
        words = _WORDS.findall(text.lower())
        words.append("")
        return np.array(self.quick.encode_ordinary(END.join(words)), f"<u{self.width}").tobytes()

    def by_word(self, text: str) -> bytes:
        words = _SPACES.split(text)
        new = list({w for w in words if w not in self.ids})
        if new and len(self.ids) >= self.known:
            self.ids.clear()
            new = list(set(words))
        for lo in range(0, len(new), BATCH):
            part = new[lo:lo + BATCH]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.ids[w] = np.array(e.ids, f"<u{self.width}").tobytes()
        return b"".join(map(self.ids.__getitem__, words))


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items (by their place in ``sizes``, each at most ``room``) of each bin."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)        # node i: the most room below it
    bins: list[list[int]] = []
    for k in order:
        need, at = sizes[k], 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(k)
        tree[at] -= need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of documents of ``sizes``."""
    whole = [[(d, s, length)] for d, n in enumerate(sizes) for s in range(0, n - length + 1, length)]
    rest = [(d, n - n % length, n % length) for d, n in enumerate(sizes) if n % length]
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], length)]
    used = [sum(p[2] for p in b) for b in bins]
    full = whole + [b for b, u in zip(bins, used, strict=True) if u == length]
    short = sorted(((u, k) for k, u in enumerate(used) if u < length), reverse=True)
    short = [(u, bins[k]) for u, k in short]
    front, back = 0, len(short) - 1
    while front < back:                 # the emptiest fills the fullest
        u, b = short[front]
        v, c = short[back]
        n = min(length - u, v)
        moved, c = _cut(c, v - n)
        short[front], short[back] = (u + n, b + c), (v - n, moved)
        if u + n == length:
            full.append(short[front][1])
            front += 1
        if v == n:
            back -= 1
    if front == back:
        u, b = short[front]
        bit = length
        while u:
            while bit > u:
                bit //= 2
            head, b = _cut(b, bit)
            full.append(head)
            u -= bit
    return full


def _cut(pieces: list[tuple[int, int, int]], at: int) -> tuple[list, list]:
    """The pieces of the first ``at`` ids, and those of the others."""
    head, tail = [], []
    for d, start, n in pieces:
        k = min(max(at, 0), n)
        if k:
            head.append((d, start, k))
        if k < n:
            tail.append((d, start + k, n - k))
        at -= n
    return head, tail


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian, two bytes each if the vocabulary allows,
    else four), the end id last."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(path)
        end = int(end_id).to_bytes(encode.width, "little")
        for b in batches:
            b["ids"] = [encode(t) + end for t in b["text"]]
            yield b[["doc_id", "ids"]]

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, ids binary")


def pack_documents(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, group: int = GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it),
    length, doc_tokens, sequence_id, offset (its place in the sequence) and ids
    (binary, little-endian, four bytes each)."""
    n_groups = max(1, docs.count() // group)
    # the row number only spreads rows, and what is written does not change
    rows = keep_table(
        tokenised(docs, path, end_id, id_col, text_col)
        .withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups))), "packing-ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from chatlens.llm.token_counts import tokenizer as load

        width = 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        ids = list(part["ids"])
        names = part["doc_id"].to_numpy(object)
        sizes = [len(x) // width for x in ids]
        out = []
        for number, pieces in enumerate(pack(sizes, length)):
            at = 0
            for d, start, n in pieces:
                own = np.frombuffer(ids[d], f"<u{width}", n, start * width)
                out.append((names[d], start, n, sizes[d], (int(key[0]) << 32) + number, at,
                            own.astype("<u4").tobytes()))
                at += n
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.groupBy("group").applyInPandas(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
