"""Benchmark decontamination by spaced seeds that miss nothing.

Texts and benchmark items are reduced to words: lower case, everything but
letters, digits and white space removed. A document is contaminated by an item
if some stretch of ``STRETCH`` words of the item (the whole item, if shorter)
agrees in at least ``SHARE`` percent of its words with the words that lie
against it. So a stretch may have c changed words, for a c that follows from
its length. A seed picks every (c + 1)-th word and ignores those between: the
words of a stretch fall into c + 1 such classes, and c changes leave one of
them whole. Of an item shorter than a stretch each class is a seed; of a longer
one the seeds are the mask ``MASKS`` laid at every position. Hashes of the
seeds of a text, from each of its positions on, are joined with those of the
items. A meeting fixes how item and text lie against each other; there the
text's words are compared with the item's one by one.

Only built-in functions. The seeds of the benchmark are broadcast behind a
check of their number; then only the part of a text that lies against an item
leaves the scan. Beyond it seeds are joined by shuffle, and the texts that
have hits are looked up again by a hash of the text.

Items under five words may have no change and match whole. Those of fewer
words than ``short_span`` (a parameter; the queries pass 1) match nothing, as
do null and empty texts and items. Repeated item ids are fine: rows of other
words are items of their own, and a null id is listed as ``null``. Documents
with the same id (also null) share one result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import SPACES, WORD_GAP, free_name, keep_table, pin

# Mask of the seeds of long items: 1 for a word that counts. A stretch of 20
# words may have 4 changes, so every fifth word is picked.
MASKS = ("1000010000100001",)
SHORT_SPAN = 5
STRETCH = 20
SHARE = 80
BROADCAST_SEEDS = 2_000_000     # rows of 20 bytes


def plain_words(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))),
                         r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    t = F.btrim(t, F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def picks(n: int) -> list[tuple[int, int, int]]:
    """First word, step and number of words of the seeds of an item of ``n``
    words."""
    if n >= STRETCH:
        mask = MASKS[0]
        step = mask.index("1", 1)
        return [(at, step, mask.count("1")) for at in range(n - len(mask) + 1)]
    step = n * (100 - SHARE) // 100 + 1
    return [(at, step, len(range(at, n, step))) for at in range(step)]


def _seed(words: str, at: str, step: int, size: int) -> Column:
    """Hash of ``size`` words from (0-based) position ``at`` on, ``step`` apart."""
    return F.xxhash64(F.lit(step * STRETCH + size), *[F.get(F.col(words), F.col(at) + step * k) for k in range(size)])


def _shapes(lengths: list[int]) -> list[tuple[int, int]]:
    """Steps and sizes of the seeds of items of these lengths."""
    return sorted({(step, size) for n in lengths for _, step, size in picks(min(n, STRETCH))})


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """item_key, item_at, seed; ``lengths`` are those of the items, STRETCH for
    longer ones."""
    n, mask = F.size("words"), MASKS[0]
    pick = lambda at, step, size: F.struct(at.alias("item_at"), F.lit(step).alias("step"), F.lit(size).alias("size"))
    (_, step, size), *_ = picks(STRETCH)
    cut = F.when(n >= STRETCH, F.transform(F.sequence(F.lit(0), n - len(mask)), lambda at: pick(at, step, size)))
    for k in lengths:
        if k < STRETCH:
            cut = cut.when(n == k, F.array(*[pick(F.lit(at), *rest) for at, *rest in picks(k)]))
    at = items.withColumn("_b", F.explode(cut)).select("item_key", "words", "_b.*")
    seed = F.coalesce(F.lit(None).cast("long"), *[
        F.when((F.col("step") == s) & (F.col("size") == k), _seed("words", "item_at", s, k)) for s, k in _shapes(lengths)])
    return at.select("item_key", "item_at", seed.alias("seed"))


def _seeds(df: DataFrame, shapes: list[tuple[int, int]], out: str, at: str) -> DataFrame:
    """A row for each position and shape of seed of the array ``words``. Where a
    seed reaches beyond the end, it is that of fewer words, which no item has.
    All in one stage of generated code, in which rows refer to the array; it
    must not be part of what leaves the stage."""
    span = min(step * (size - 1) + 1 for step, size in shapes)
    placed = (df.filter(F.size("words") >= span)
              .withColumn(at, F.explode(F.sequence(F.lit(0), F.size("words") - span))))
    return placed.withColumn(out, F.explode(F.array(*[_seed("words", at, *shape) for shape in shapes])))


def _agreement(same: Column) -> Column:
    """Largest number of equal words in a stretch of the item, as a percent
    rounded down; ``same`` has 1 for each word of the item that the text's word
    equals, else 0."""
    n = F.size(same)
    width = F.least(F.lit(STRETCH), n)
    sums = F.transform(F.sequence(F.lit(1), n - width + 1),
                       lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda s, x: s + x))
    return F.floor(F.array_max(sums) * 100 / width)


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text",
             carry: tuple[str, ...] = (), short_span: int = SHORT_SPAN, by_item: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, doc_id, item_id, percent: the best agreement of each
    contaminated document with each item (at least ``SHARE``). ``by_item`` may
    name item_key, which tells items of one id apart."""
    items = pin(bench.select(bench[item_col].alias("item_id"), bench[item_text_col].alias("_t")),
                words=plain_words(F.col("_t"))).drop("_t").dropDuplicates(["item_id", "words"])
    items = items.withColumn("item_key", F.xxhash64("item_id", "words"))
    items = items.filter(F.size("words") >= max(1, short_span))
    # at most a row for each length under a stretch, and one for the others
    length = F.least(F.size("words"), F.lit(STRETCH))
    counts = {r["k"]: r["n"] for r in items.groupBy(length.alias("k")).agg(F.sum(F.size("words")).alias("n")).collect()}
    lengths = sorted(counts)
    seeds = _item_seeds(items, lengths)
    shapes = _shapes(lengths or [STRETCH])
    named = items.select("item_key", "item_id", F.col("words").alias("item_words"))
    start = F.col("at") - F.col("item_at")
    keep = [*carry, "doc_id"]
    slim = docs.select(*[F.col(f"`{c}`") for c in carry], docs[id_col].alias("doc_id"),
                       docs[text_col].alias("_t"))
    if sum(counts.values()) <= BROADCAST_SEEDS:
        longest = items.agg(F.max(F.size("words"))).first()[0] or 0
        texts = pin(slim, words=plain_words(F.col("_t"))).drop("_t")
        # only the words beside a meeting leave the stage that reads the texts
        cut = F.greatest(F.lit(0), start)
        met = (_seeds(texts, shapes, "seed", "at").join(F.broadcast(seeds), "seed")
               .select(*keep, "item_key", (start - cut).alias("start"),
                       F.slice("words", cut + 1, F.lit(max(1, longest))).alias("words"))
               .join(F.broadcast(named), "item_key"))
    else:
        keyed = slim.withColumn("text_key", F.xxhash64("_t"))
        texts = pin(keyed, words=plain_words(F.col("_t"))).drop("_t")
        hits = (_seeds(texts.select("text_key", "words"), shapes, "seed", "at")
                .select("text_key", "seed", "at").join(seeds, "seed")
                .select("text_key", "item_key", start.alias("start")).distinct())
        met = texts.join(hits, "text_key").join(named, "item_key")
    # the word of the text that lies against each word of the item
    against = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), lambda k: F.when(
        F.col("start") + k >= 0, F.get(F.col("words"), F.col("start") + k)))
    same = F.zip_with("item_words", against, lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.lit(STRETCH), F.size("same"))
    # few meetings agree in enough words at all, and only those are looked at by stretches
    rated = (pin(met.select(*keep, "item_id", *by_item, "item_words", "start", "words"), same=same)
             .filter(F.aggregate("same", F.lit(0), lambda s, x: s + x) * 100 >= width * SHARE)
             .withColumn("percent", _agreement(F.col("same")))
             .filter(F.col("percent") >= SHARE))
    return rated.groupBy(*keep, "item_id", *by_item).agg(F.max("percent").alias("percent"))


def contaminated(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """The contaminated documents: doc_id, n_items, item_ids (comma joined,
    ascending, null ids last), percent (of the best item). Clean documents have
    no row."""
    found = overlaps(docs, bench, by_item=("item_key",), **names)
    named = F.array_sort(F.collect_set(F.struct(F.col("item_id").isNull().alias("none"), "item_id")))
    ids = F.transform(named, lambda i: F.coalesce(i["item_id"].cast("string"), F.lit("null")))
    return (found.groupBy("doc_id")
            .agg(F.count_distinct("item_key").alias("n_items"), F.array_join(ids, ",").alias("item_ids"),
                 F.max("percent").alias("percent")))


def without_benchmark(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated rows (told by id and hash of the text)."""
    key, own = free_name(docs, "_text_key"), free_name(docs, "_id")
    keyed = docs.withColumn(key, F.xxhash64(docs[text_col].cast("string"))).withColumn(own, docs[id_col])
    found = keep_table(overlaps(keyed, bench, id_col, text_col, carry=(key,), **names)
                       .select("doc_id", F.col(key).alias("found_key")).distinct(), "contaminated")
    same = (F.col(key) == found["found_key"]) & F.col(own).eqNullSafe(found["doc_id"])
    return keyed.join(found, same, "left_anti").drop(key, own)
