"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a fixed pseudo-random order and cut into
blocks. With integer weights that add up to W, block i of a source of weight w
may run from slot floor(i*W/w) on (its release) and must have run before slot
ceil((i+1)*W/w) (its deadline). In each slot the released block with the
earliest deadline runs (ties: the order of the sources in the parameter). The
weights use every slot, so all deadlines are met, and after every slot each
source has had its share of the slots to within less than one block.

The schedule repeats every W slots, whatever the data, so it is laid out once
for the W slots of a period (a parameter table of fixed size); a row's slot
follows from its row number within the source by arithmetic and one look-up.
Row numbers are counted per (source, hash bucket) and shifted by the counts
of the buckets before, so a source with most of the rows is spread over all
buckets. Only built-in functions; nothing is dropped or repeated.

Sources without a weight of their own, and null sources, share the weight of
``OTHER``. Sources of the parameter that have no rows take no part. When a
source runs out, its later slots stay empty; ``on_target`` marks the rows
before the first slot that stays empty. Equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import free_name, local_table

OTHER = "*"
WEIGHTS = {"src0": 20, **{f"src{k}": 4 for k in range(1, 20)}, OTHER: 4}
BLOCK = 16              # rows of a block
BUCKET_HEX = 3          # hash buckets of a source: 16 ** 3


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the blocks of one period."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    out = []
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // w), k, s) for k, (s, w) in enumerate(weights.items())
                 if done[s] < w and done[s] * total // w <= slot]
        deadline, _, s = min(ready)
        out.append((s, done[s], slot, done[s] * total // weights[s], deadline))
        done[s] += 1
    return out


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``carry`` and doc_id, source, row (number within the source's
    class), block, slot, release, deadline, position (slot and place in the
    block as one rising number) and on_target."""
    weights = dict(WEIGHTS if weights is None else weights)
    spark = docs.sparkSession
    named = [s for s in weights if s != OTHER]
    source, doc = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    base = docs.select(
        *[F.col(f"`{c}`") for c in carry], doc.alias("_id"), source.alias("_source"),
        F.when(source.isin(named), source).otherwise(F.lit(OTHER)).alias("_class"),
        F.md5(F.concat_ws("\x1f", F.coalesce(doc.cast("string"), F.lit("")),
                          F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
        .alias("_key")
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX))
    counts = base.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["_class"]: r["_n"] for r in     # at most one row for each weight
             counts.groupBy("_class").agg(F.sum("_n").alias("_n")).collect()}
    present = {s: w for s, w in weights.items() if s in sizes}
    if set(sizes) - set(weights):
        raise ValueError(f"a weight for {OTHER!r} is needed: there are sources without one")
    total = sum(present.values())
    laid = period(present)
    # the first slot that stays empty: that of the first block that is not full
    place = {(s, k): slot for s, k, slot, _, _ in laid}
    empty = min((n // block // present[s] * total + place[s, n // block % present[s]]
                 for s, n in sizes.items()), default=0)
    plan = local_table(spark, [(s, k, present[s], slot, release, deadline)
                               for s, k, slot, release, deadline in laid],
                       "_class string,_k long,_w long,_slot long,_release long,_deadline long")
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_class", "_bucket").orderBy("_key")
    rows = (base.withColumn("_row", F.row_number().over(own) - 1)
            .join(shifts, ["_class", "_bucket"])
            .withColumn("_row", F.col("_row") + F.col("_before"))
            .withColumn("_block", F.floor(F.col("_row") / block)))
    weight = local_table(spark, list(present.items()), "_class string,_weight long")
    rows = (rows.join(F.broadcast(weight), "_class")       # a row for each weight
            .withColumn("_k", F.col("_block") % F.col("_weight"))
            .withColumn("_cycle", F.floor(F.col("_block") / F.col("_weight")))
            .join(F.broadcast(plan), ["_class", "_k"]))    # a row for each slot of a period
    turn = F.col("_cycle") * total
    slot = turn + F.col("_slot")
    return rows.select(
        *[F.col(f"`{c}`") for c in carry], F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"), F.col("_row").alias("row"),
        F.col("_block").alias("block"), slot.alias("slot"),
        (turn + F.col("_release")).alias("release"), (turn + F.col("_deadline")).alias("deadline"),
        (slot * block + F.col("_row") % block).alias("position"),
        (slot < F.lit(empty)).alias("on_target"))


def in_mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK,
                   source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, with its columns, sorted by position (files
    written from it hold the sources in the target weights, in order)."""
    whole = free_name(docs, "_row_of_docs")
    packed = docs.withColumn(whole, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    placed = schedule(packed, weights, block, source_col=source_col, carry=(whole,))
    return placed.sort("position", "doc_id").select(f"{whole}.*")
