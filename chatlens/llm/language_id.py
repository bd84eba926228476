"""Language identification in two steps: family, then language.

Texts are lower-cased, everything but letters becomes one space, and the
hashed counts of their character 1-, 2- and 3-grams are scaled to length 1. A
one-versus-one linear support vector machine first picks the family; among
the languages of that family others pick the language (votes, then margins).

The models are fitted on the driver on a bounded sample of labelled rows: of
each language the ``per_language`` rows whose id has the least hash, at most
``max_rows`` together (of rows with the same id one teaches, the least by
language and features); only their sparse features leave the executors. All
else runs over all rows, in one narrow pass. Whole texts are read.

Languages that FAMILIES does not name are a family of their own. A null text
and one without a letter are ``und`` with score 0, as is every text if no
labelled row was given. A row in gives a row out.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm.common import free_name, keep_table

UND = "und"
# ISO 639-1 codes of some language families.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
DIM = 1 << 13           # hashed features
PER_LANGUAGE = 400      # rows of a language in the sample
MAX_ROWS = 4000         # rows of the sample
PREFIX_HEX = 3          # digits of the id hashes that are counted to find those rows
# also without number characters that are no digits, such as fractions
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
_NOT_LETTERS = re.compile(rf"[\W\d_{_NUMBERS}]+")
_NOT_WORD = re.compile(r"[\W\d_]+")     # without these numbers: far quicker, and they are rare


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "=" + lang)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def letters(text: str | None) -> str:
    """The text in lower case with a space for all that is no letter."""
    plain = _NOT_WORD.sub(" ", (text or "").lower())
    if not plain.replace(" ", "").isalpha():
        plain = _NOT_LETTERS.sub(" ", plain)
    return plain.strip()


def features(text: str | None) -> np.ndarray | None:
    """Feature vector of a text, or None without a letter."""
    plain = letters(text)
    if not plain:
        return None
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(2246822519)
    three = (two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(3266489917)
    counts = np.bincount(np.concatenate((one, two, three)) >> np.uint32(32 - 13), minlength=DIM)
    x = counts.astype(np.float32)
    return x / np.sqrt(x @ x)


def _fit_pair(x: np.ndarray, y: np.ndarray, rounds: int = 20, cost: float = 10.0) -> np.ndarray:
    """Linear SVM (squared hinge loss) by dual coordinate descent; y is 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class OneVersusOne:
    """Linear machines for all pairs of a few classes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        at = np.array([self.classes.index(v) for v in labels])
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = [(at == a) | (at == b) for a, b in self.pairs]
        self.weights = np.array([_fit_pair(x[r], np.where(at[r] == a, 1.0, -1.0))
                                 for r, (a, _) in zip(rows, self.pairs, strict=True)],
                                np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Winner of each row and its score: the mean over its pairs of the
        logistic function of the margin (1 with a single class)."""
        n, k = len(x), len(self.classes)
        if not self.pairs:
            return [self.classes[0]] * n, np.ones(n)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, sure = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        p = 1 / (1 + np.exp(-3.0 * margin))
        for j, (a, b) in enumerate(self.pairs):
            won = margin[:, j] >= 0
            votes[:, a] += won
            votes[:, b] += ~won
            sums[:, a] += margin[:, j]
            sums[:, b] -= margin[:, j]
            sure[:, a] += p[:, j]
            sure[:, b] += 1 - p[:, j]
        best = np.argmax(votes + 1e-3 * np.tanh(sums), axis=1)
        return [self.classes[b] for b in best], sure[np.arange(n), best] / (k - 1)


class Model:
    """Family machine and a machine for each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family_of(v) for v in langs]
        self.top = OneVersusOne(x, families) if langs else None
        self.within = {}
        for f in set(families):
            rows = [k for k, v in enumerate(families) if v == f]
            self.within[f] = OneVersusOne(x[rows], [langs[k] for k in rows])

    def predict(self, texts) -> pd.DataFrame:
        vectors = [features(t) for t in texts] if self.top else [None] * len(texts)
        known = [k for k, v in enumerate(vectors) if v is not None]
        langs, scores = [UND] * len(vectors), [0.0] * len(vectors)
        if known:
            x = np.array([vectors[k] for k in known])
            families, sure = self.top.predict(x)
            for f in set(families):
                rows = [j for j, v in enumerate(families) if v == f]
                found, own = self.within[f].predict(x[rows])
                for j, lang, s in zip(rows, found, own, strict=True):
                    langs[known[j]] = lang
                    scores[known[j]] = float(min(1.0, max(0.0, sure[j] * s)))
        return pd.DataFrame({"lang_pred": langs, "score": scores})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows that are not held out and have a text and a language."""
    usable = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"),
                         docs[text_col].cast("string").alias("text")) \
        .filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UND)
                & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # a histogram of the hashes tells up to which prefix a language's rows are
    # looked at, so few of them meet in the task that picks the first ones
    hashed = usable.select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("hash")) \
        .withColumn("prefix", F.substring("hash", 1, PREFIX_HEX))
    counts = keep_table(hashed.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    n_langs = counts.select("lang").distinct().count()
    each = max(1, min(per_language, max_rows // max(1, n_langs)))
    before = Window.partitionBy("lang").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .filter(F.col("before") < each).groupBy("lang").agg(F.max("prefix").alias("last")))
    if n_langs <= max_rows:     # a row for each language
        bounds = F.broadcast(bounds)
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ids = (hashed.join(bounds, "lang").filter("prefix <= last").withColumn("_n", F.row_number().over(by_hash))
           .filter(F.col("_n") <= each).select("doc_id").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, lang, text in zip(b["doc_id"], b["lang"], b["text"], strict=True):
                v = features(text)
                if v is not None:
                    at = np.flatnonzero(v)
                    rows.append((doc_id, lang, at.astype("<u2").tobytes(), v[at].astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "at", "value"])

    sample = (usable.withColumn("doc_id", F.col("doc_id").cast("string"))
              .join(F.broadcast(ids.select(F.col("doc_id").cast("string").alias("doc_id"))), "doc_id", "left_semi")
              .mapInPandas(run, "doc_id string, lang string, at binary, value binary"))
    once = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "at", "value")).alias("row")).select("doc_id", "row.*")
    # two bytes of place and four of value for each feature, by Arrow
    rows = once.toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.zeros((len(rows), DIM), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[k, np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(value.as_buffer(), "<f4")
    return Model(x, rows["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a struct column ``out`` of lang_pred and score."""
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat([model.predict(texts.iloc[lo:lo + 128]) for lo in range(0, len(texts), 128)]
                            or [model.predict(texts)], ignore_index=True)

    return docs.withColumn(out, run(F.col(f"`{text_col}`").cast("string")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from ``docs`` itself."""
    model = fit(docs, id_col, text_col, lang_col)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return predict(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def with_language(docs: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows whose text is null or has no letter: those that
    are ``und`` under a model. Where nothing could be learned all texts are
    ``und``, and the letters alone decide."""
    found = free_name(docs, "_found")
    model = fit(docs, text_col=text_col, **names)
    if model.top is None:
        @F.pandas_udf(T.BooleanType())
        def lettered(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(letters(t)) for t in texts], dtype=bool)

        return docs.filter(lettered(F.col(f"`{text_col}`").cast("string")))
    return predict(docs, model, text_col, found).filter(F.col(found)["lang_pred"] != UND).drop(found)
