"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``chunk`` characters is encoded at once. A longer one is cut
into chunks that overlap; each is encoded with offsets, and neighbours are
spliced at a boundary that is proven to be one of the whole text:

* the pre-tokeniser scans from left to right and keeps no state but its
  position, and tokens never cross its words; so if the scan of the whole text
  and the scan of a chunk both start a word at a position, both agree on all
  that follows, up to the end of the chunk;
* the first chunk starts where the text starts, so its words are the text's
  own, except near its end, where a word may be cut short (``EDGE``
  characters, longer than any look-ahead and any special token, and the words
  that reach into them, are not trusted);
* hence a word start that a trusted stretch and the next chunk have in common
  is stable, and from there on the next chunk's words are the text's own.

If the overlap holds no such position (one word longer than the overlap, for
instance), the next chunk starts further to the left, the overlap doubling
until it finds one; at worst it starts at the last proven boundary. If a
chunk itself makes no progress (one word longer than the chunk), it is read on
to the right with doubled length.

Texts are never shortened. Null and empty texts have no tokens.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 16         # characters encoded at once
OVERLAP = 1 << 10       # characters that neighbours share at first
EDGE = 32               # characters before a cut that are not trusted

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokeniser of a file, loaded once per Python worker."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _words(tok, text: str) -> tuple[list[int], list[int]]:
    """Where words start, and how many tokens come before each of them."""
    enc = tok.encode(text, add_special_tokens=False)
    starts, before, last = [], [], object()
    for k, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word is None or word != last:
            starts.append(a)
            before.append(k)
        last = word
    starts.append(len(text))
    before.append(len(enc.ids))
    return starts, before


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> int:
    """Number of tokens of ``text``, of which at most a chunk and an overlap
    (more only where alignment fails) are encoded at a time."""
    total, proven = 0, 0            # tokens before the last proven boundary
    lap, reach = overlap, chunk     # how far a chunk goes to its left and right
    while True:
        left, right = max(0, proven - lap), min(len(text), proven + reach)
        starts, before = _words(tok, text[left:right])
        at = {left + s: n for s, n in zip(starts, before, strict=True)}
        if proven not in at:        # not aligned: widen the overlap
            lap = lap * 2 if lap * 2 < min(proven, chunk) else 0
            continue
        if right == len(text):
            return total + at[right] - at[proven]
        # the last word that starts well before the cut is the text's own
        cut = max((left + s for s in starts[:-1] if left + s <= right - edge), default=proven)
        if cut <= proven:           # a word longer than the chunk: read on
            reach *= 2
            continue
        total += at[cut] - at[proven]
        proven, lap, reach = cut, overlap, chunk


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A row in
    gives a row out. One narrow pass, no shuffle."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        tok = tokenizer(path)
        texts = list(texts)
        counts = [0] * len(texts)
        small = [k for k, t in enumerate(texts) if len(t) <= chunk]
        for lo in range(0, len(small), 64):
            part = small[lo:lo + 64]
            encoded = tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)
            for k, e in zip(part, encoded, strict=True):
                counts[k] = len(e)
        for k, t in enumerate(texts):
            if len(t) > chunk:
                counts[k] = count_long(tok, t, chunk, overlap)
        return pd.Series(counts, dtype="int64")

    return (docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        n_tokens(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
