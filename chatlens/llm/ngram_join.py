"""Jaccard self-join of documents on word shingles, by PartEnum signatures.

A document's set holds its distinct shingles of five words. Two documents link
when 100 * intersection >= 75 * union; the result is the connected components.

1. Equal sets are one node. One pass over the texts gives each document its
   set's 128-bit digest, size, a profile (counts of the set's hashes in a few
   classes, at most a byte for four shingles) and signatures
   (``shingles.signatures``: linked sets share at least one). A node's number is
   half of the digest; where sets with different digests have the same number,
   it is told apart by the other half and the pass is made again.
2. In the same pass signatures meet; those of one node only are dropped. What
   is left are buckets (signature, node), kept in the shared folder with the
   documents' rows; of buckets with the same nodes one stays. Signatures of
   many sampled sets are known to be shared, so their rows need not meet and
   are spread; texts are not read again but for candidates.
3. Rounds: in each bucket that holds more than one component so far, the nodes
   outside its largest component are compared with one node of it, so groups
   of copies join up in a few rounds without any pairs within the group.
   Rounds stop when one finds less than a twentieth of the first one's links.
4. The rest, exactly: what buckets still hold of nodes of different
   components is compared in full, in small buckets as distinct pairs, in
   large ones in blocks of at most ``BLOCK`` nodes a side: first by their
   profiles, then the sets of those that may have a link there, of which only
   links leave the task. Nodes that share many large buckets are compared in the
   first of them. After that no pair that shares a signature is left open.

A pair is first tested by the profiles (no true link fails), then by the whole
shingle sets, which are computed from the texts of such candidates only.

Null and empty texts and texts without words have an empty set, linked with
nothing; their component is their own id. Rows with a null id take part in
links; a component's id is its smallest id that is not null. Rows in are rows
out, also repeated ones. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm import shingles as S
from chatlens.llm.common import free_name, keep_table
from chatlens.session import shared_scratch

SAMPLE = 16             # one text in so many is looked at for frequent shingles
FREQUENT = 200_000      # most of them, at most (8 bytes each)
HOT = 64                # sampled sets that make a signature a hot one
HOT_LIST = 100_000      # hot signatures that are spread, at most (8 bytes each); the others meet in one task
SPREAD = 4096           # ways that the rows of a hot signature are spread
SMALL = 32              # nodes of a bucket that is compared pair by pair
BLOCK = 2048            # nodes of a block of a larger one, at most
BLOCK_SHINGLES = 1 << 21    # shingles of a block, about
STRIPE = 256            # nodes of a block whose counts are compared with the other block's at a time
WIDE = 1024             # shingles whose owners are held as a matrix at a time
MET = 16                # earlier large buckets that a node's row names, at most; they move work, never results
ROUNDS = 6              # rounds of step 3 at most; step 4 does what they leave
SEEN = 1 << 20          # nodes or texts that a task remembers, to emit copies once
MAP_BITS = 1 << 27      # bits of a map of keys, at most (16 MB); it moves work, never results
CHUNK = 1 << 15         # bits of a map that are put together in one row
MAP_CHUNKS = 64         # such rows that a task puts together, about
TASK_ROWS = 1 << 16     # rows of edges between components that are one task, about


def _sample(texts: DataFrame) -> DataFrame:
    return (texts.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).dropDuplicates(["text_key"])
            .select("doc_id", "text_key", "text"))


def _frequent(sample: DataFrame) -> np.ndarray:
    """Shingles that sampled texts share. They only move signatures to the end
    of an order, so which ones are found changes no result."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):
                sets = [S.shingle_set(t) for t in b["text"].iloc[lo:lo + 64]]
                yield pd.DataFrame({"shingle": np.concatenate(sets).view(np.int64)})

    rows = (sample.select("text").mapInPandas(run, "shingle long")
            .groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow())
    return np.sort(rows["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def _number(s: np.ndarray, split: frozenset[int], digest: Callable) -> tuple[int, int]:
    """A set's node and the other half of its digest. Nodes of ``split`` are
    those of several sets, which the other half tells apart."""
    node, check = digest(s)
    while node in split:
        half = np.array([node, check], np.int64).view(np.uint64)
        node = int(S.mix(S.mix(half[:1]) ^ half[1:]).view(np.int64)[0])
    return node, check


def _described(texts: DataFrame, frequent: np.ndarray, number: Callable) -> DataFrame:
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("check", T.LongType()),
                           T.StructField("n_shingles", T.LongType()),
                           T.StructField("profile", T.BinaryType()),
                           T.StructField("signatures", T.ArrayType(T.LongType()))])

    @F.pandas_udf(schema)
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for text in b:
                s = S.shingle_set(text)
                node, check = number(s)
                new = len(s) > 0 and node not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                row = (node, check, len(s), S.profile(s) if new else None,
                       S.signatures(s, frequent).view(np.int64) if new else None)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pd.DataFrame(out)

    return (texts.select("doc_id", "text_key", described("text").alias("d"))
            .select("doc_id", "text_key", "d.*"))


def _hot(sample: DataFrame, frequent: np.ndarray, number: Callable) -> DataFrame:
    """Signatures of many sampled texts, which need not prove that others have
    them too. Should all be copies of one set, its bucket joins nothing."""
    return (_described(sample, frequent, number).select(F.explode("signatures").alias("signature"))
            .groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
            .orderBy(F.desc("n"), "signature").limit(HOT_LIST).select("signature"))


def _parted(held: np.ndarray):
    """Signatures of a list in two parts: the others, then those of ``held``
    (sorted, ``HOT_LIST`` at most). The list of hot ones rides with the task,
    so that no row meets another to learn whether its signature is hot."""
    schema = T.StructType([T.StructField("signatures", T.ArrayType(T.LongType())),
                           T.StructField("n_cold", T.IntegerType())])

    @F.pandas_udf(schema)
    def parted(lists: pd.Series) -> pd.DataFrame:
        out, n_cold = [], []
        for own in lists:
            if own is None:
                out.append(None)
                n_cold.append(0)
                continue
            at = np.searchsorted(held, own)
            at[at == len(held)] = 0
            hot = held[at] == own
            out.append(np.concatenate((own[~hot], own[hot])) if hot.any() else own)
            n_cold.append(len(own) - int(hot.sum()))
        return pd.DataFrame({"signatures": pd.Series(out, dtype=object),
                             "n_cold": np.array(n_cold, np.int32)})

    return parted


def _rows(described: DataFrame, hot: DataFrame) -> DataFrame:
    """A row for each document (``doc`` is set, ``signature`` null) and the
    rows (signature, node) of the signatures that several nodes have. Document
    rows go through the same exchange, each under a key of its own."""
    doc = F.struct("doc_id", "text_key", "check", "n_shingles", "profile")
    none = F.lit(None).cast("long")
    held = np.sort(hot.toArrow()["signature"].to_numpy().astype(np.int64))
    if len(held):
        described = described.withColumn("parted", _parted(held)("signatures")).select(
            *[c for c in described.columns if c != "signatures"], "parted.*")
    else:
        described = described.withColumn("n_cold", F.size("signatures"))
    # a list of the document's own entry and its signatures, hot ones last
    entries = F.concat(F.array(none), F.coalesce(F.col("signatures"), F.array().cast("array<bigint>")))
    rows = (described.select("node", doc.alias("doc"), "n_cold", F.posexplode(entries).alias("at", "signature"))
            .withColumn("doc", F.when(F.col("signature").isNull(), F.col("doc")))
            .withColumn("spread", F.when(F.col("at") == 0, F.monotonically_increasing_id())
                        .when(F.col("at") > F.col("n_cold"), 1 + F.pmod("node", F.lit(SPREAD))).otherwise(0)))
    own = Window.partitionBy("signature", "spread")
    # a node next to its signature, without zeros between, is sent in fewer bytes
    met = (rows.select("node", "signature", "spread", "doc")
           .withColumn("lo", F.min("node").over(own)).withColumn("hi", F.max("node").over(own)))
    return (met.filter(F.col("signature").isNull() | (F.col("spread") > 0) | (F.col("lo") != F.col("hi")))
            .select("signature", "spread", "node", "doc").dropDuplicates(["signature", "spread", "node"])
            .select("signature", "node", "doc"))


def _key_map(keys: DataFrame, col: str) -> np.ndarray:
    """A map of bits, set where a key of ``keys`` falls, 16 for a key or
    ``MAP_BITS``. Rows whose bit is not set need not be shuffled to a join with
    ``keys``; the join still decides on the others."""
    bits, wanted = CHUNK, min(16 * keys.count(), MAP_BITS)
    while bits < wanted:
        bits *= 2
    rows = (keys.select(F.pmod(col, F.lit(bits)).alias("bit"))
            .groupBy(F.floor(F.col("bit") / CHUNK).alias("chunk"))
            .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(CHUNK))).alias("set"))
            # a few rows, mostly: no task for each partition of the shuffle
            .coalesce(-(-bits // (CHUNK * MAP_CHUNKS))).toArrow())
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for chunk, some in zip(rows["chunk"].to_pylist(), rows["set"], strict=True):
        out[chunk] = np.frombuffer(some.as_buffer(), np.uint8)
    return out.reshape(-1)


def _on_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _perhaps_in(bits: np.ndarray):
    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(_on_map(bits, keys.to_numpy()))

    return test


def _sets(texts: DataFrame, need: DataFrame, number: Callable) -> DataFrame:
    """(node, shingles as bytes) of ``need`` (node, text_key). Of the texts
    only the sets that may be needed are shuffled, copies once a task."""
    bits = _key_map(need, "text_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            keys, nodes, sets = b["text_key"].to_numpy(), [], []
            for i in np.flatnonzero(_on_map(bits, keys)).tolist():
                if int(keys[i]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(int(keys[i]))
                s = S.shingle_set(b["text"].iat[i])
                nodes.append(number(s)[0])
                sets.append(s.tobytes())
            yield pd.DataFrame({"node": np.array(nodes, np.int64), "shingles": pd.Series(sets, dtype=object)})

    found = texts.select("text_key", "text").mapInPandas(run, "node long, shingles binary")
    return found.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _both(pairs: DataFrame, of_nodes: DataFrame, *cols: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(of_nodes.select(F.col("node").alias(side),
                                           *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
    return pairs


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * S.DEN >= F.greatest(n, m) * S.NUM


def _may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of a kept table that sizes and profiles leave. Only profiles of
    nodes of such pairs are shuffled."""
    @F.pandas_udf("boolean")
    def test(n: pd.Series, p: pd.Series, m: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([S.may_link(*x) for x in zip(n, p, m, q, strict=True)], dtype=bool)

    near = _both(pairs, _only(nodes, _ends(pairs)), "n_shingles", "profile").filter(
        _sizes_fit(F.col("n_shingles_a"), F.col("n_shingles_b")))
    return near.filter(test("n_shingles_a", "profile_a", "n_shingles_b", "profile_b")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([S.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                          for x, y in zip(a, b, strict=True)], dtype=bool)

    both = _both(pairs, _only(sets, _ends(pairs)), "shingles")
    return both.filter(test("shingles_a", "shingles_b")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` without most of those that a join with ``nodes`` drops."""
    return rows.filter(_perhaps_in(_key_map(nodes, "node"))("node"))


def _distinct_buckets(buckets: DataFrame) -> DataFrame:
    """One of the buckets that hold the same nodes (told by their number and
    a 128-bit hash): linked texts share many signatures."""
    alike = (buckets.groupBy("signature")
             .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                  F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
             .groupBy("n", "x", "y").agg(F.min("signature").alias("signature")).select("signature"))
    return buckets.join(alike, "signature", "left_semi")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the components that ``links`` join made
    one, under their least label. Components hook onto the least one that they
    are linked with, then chains are shortened; the number of components that
    are not whole at least halves in each round. Labels are read once before
    the rounds and once after; the rounds have the edges between components
    only, in as many tasks as their number asks for."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side)
    tasks = -(-links.count() // TASK_ROWS) or 1
    edges = keep_table(_edges(ends.select("la", "lb")).coalesce(tasks), "ngram-edges")
    if edges.isEmpty():
        return labels
    now = keep_table(edges.select("label").union(edges.select("root")).distinct()
                     .select("label", F.col("label").alias("root")).coalesce(tasks), "ngram-roots")
    while not edges.isEmpty():
        up = keep_table(edges.groupBy("label").agg(F.min("root").alias("root")).coalesce(tasks), "ngram-hooks")
        far = up
        for _ in range(3):
            far = _moved(far, up, "root")
        up = keep_table(far.coalesce(tasks), "ngram-hooks")
        now = keep_table(_moved(now, up, "root").coalesce(tasks), "ngram-roots")
        moved = _moved(_moved(edges, up, "label"), up, "root")
        edges = keep_table(_edges(moved.select(F.col("label").alias("la"), F.col("root").alias("lb")))
                           .coalesce(tasks), "ngram-edges")
    return keep_table(_moved(labels, now, "label"), "ngram-labels")


def _edges(ends: DataFrame) -> DataFrame:
    return (ends.filter("la <> lb")
            .select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("root")).distinct())


def _moved(rows: DataFrame, up: DataFrame, col: str) -> DataFrame:
    """``rows`` with the root that ``up`` (label, root) has for ``col``, if any."""
    over = up.select(F.col("label").alias(col), F.col("root").alias("over"))
    return rows.join(over, col, "left").select(
        *[F.coalesce("over", c).alias(c) if c == col else F.col(c) for c in rows.columns])


def _open(buckets: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of buckets with several components: signature, node, label,
    n_shingles, and the bucket's size and its largest component (main; least
    of equals)."""
    rows = buckets.join(labels.join(nodes.select("node", "n_shingles"), "node"), "node")
    parts = rows.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = (parts.groupBy("signature")
             .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"),
                  F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
             .filter("parts > 1").select("signature", "size", "main"))
    return rows.join(whole, "signature")


def _star_pairs(still: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's nodes outside its main component with one node of
    that, if their sizes fit."""
    mains = (still.filter("label = main").groupBy("signature")
             .agg(F.min_by(F.struct("node", "n_shingles"), F.xxhash64("node", F.lit(turn))).alias("hub")))
    return (still.filter("label <> main").join(mains, "signature")
            .filter(_sizes_fit(F.col("n_shingles"), F.col("hub.n_shingles")))
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())


def _small_pairs(still: DataFrame) -> DataFrame:
    rows = still.filter(F.col("size") <= SMALL)
    x = rows.select("signature", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("n"))
    y = rows.select("signature", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("m"))
    return (x.join(y, "signature").filter("a < b and la <> lb").filter(_sizes_fit(F.col("n"), F.col("m")))
            .select("a", "b").distinct())


def _large(still: DataFrame) -> DataFrame:
    """Rows of the larger buckets: signature, node, aside, block and n_blocks
    (of the nodes aside) and n_main_blocks. Of the nodes of a bucket that need
    not be compared with each other the most are its main group (aside 0):
    either its main component, or nodes that all share the same earlier bucket,
    where they are met. A block holds as many nodes as keep its sets small.
    ``met`` has the least ``MET`` of the node's earlier larger buckets: nodes
    that both name one have been met there, or in an earlier one yet."""
    by_node = Window.partitionBy("node").orderBy("signature")
    rows = (still.filter(F.col("size") > SMALL)
            .withColumn("earlier", F.lag("signature").over(by_node))
            .withColumn("least", F.when(F.row_number().over(by_node) <= MET, F.col("signature")))
            .withColumn("met", F.collect_list("least").over(by_node.rowsBetween(Window.unboundedPreceding, -1))))
    shared = (rows.filter("earlier IS NOT NULL").groupBy("signature", "earlier").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("signature").agg(F.max(F.struct("n", "earlier")).alias("most")))
    whole = (rows.groupBy("signature").agg(F.count(F.when(F.col("label") == F.col("main"), 1)).alias("n_main"),
                                           F.max("n_shingles").alias("longest"))
             .join(shared, "signature", "left"))
    by_bucket = F.coalesce(F.col("most.n"), F.lit(0)) > F.col("n_main")
    in_main = F.when(by_bucket, F.coalesce(F.col("earlier") == F.col("most.earlier"), F.lit(False))) \
        .otherwise(F.col("label") == F.col("main"))
    n_main = F.greatest(F.coalesce(F.col("most.n"), F.lit(0)), F.col("n_main"))
    block = F.greatest(F.lit(BLOCK // 8), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.col("longest"))))
    return (rows.join(whole, "signature").filter(n_main < F.col("size"))
            .withColumn("aside", F.when(in_main, 0).otherwise(1))
            .withColumn("n_blocks", F.ceil((F.col("size") - n_main) / block))
            .withColumn("n_main_blocks", F.ceil(n_main / block))
            .withColumn("block", F.pmod(F.xxhash64("node", "signature"),
                                        F.when(in_main, F.col("n_main_blocks")).otherwise(F.col("n_blocks"))))
            .select("signature", "node", "label", "aside", "block", "n_blocks", "n_main_blocks", "n_shingles", "met"))


def _units(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each node and pair of blocks (first, second) that it takes
    part in, with its own block, size, profile and ``met``. Blocks aside meet
    each other and those of the main group, whose numbers are negative."""
    others = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)
    own = F.when(F.col("aside") == 0, -F.col("block") - 1).otherwise(F.col("block"))
    units = F.when(F.col("aside") == 0, F.transform(others, lambda o: F.struct(
        o.alias("first"), (-F.col("block") - 1).alias("second")))).otherwise(
        F.concat(F.transform(others, lambda o: F.struct(F.least("block", o).alias("first"),
                                                        F.greatest("block", o).alias("second"))),
                 F.when(F.col("n_main_blocks") > 0, F.transform(
                     F.sequence(F.lit(1).cast("long"), F.col("n_main_blocks")),
                     lambda o: F.struct(F.col("block").alias("first"), (-o).alias("second")))).otherwise(
                     F.array().cast("array<struct<first:bigint,second:bigint>>"))))
    return (large.join(_only(nodes, large).select("node", "profile"), "node")
            .withColumn("own", own).withColumn("unit", F.explode(units))
            .select("signature", "unit.first", "unit.second", "own", "node", "label", "n_shingles", "profile", "met"))


def _block_near(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the pairs of blocks, without the nodes that the profiles tell
    can't be linked with any node of the other block that they first meet
    there. Profiles are a small part of the sets, which only the nodes left need."""
    cols = ["signature", "first", "second", "own", "node", "label"]

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        first = (unit["own"] == unit["first"]).to_numpy()
        second = (unit["own"] == unit["second"]).to_numpy()
        keep = _have_near(unit["n_shingles"].to_numpy(), unit["profile"].to_list(), unit["label"].to_numpy(),
                          np.flatnonzero(first), np.flatnonzero(second), _coded(unit["met"].to_list()))
        return unit.loc[keep, cols]

    return (_units(large, nodes).groupBy("signature", "first", "second")
            .applyInPandas(run, ", ".join(f"{c} long" for c in cols)))


def _coded(lists: list) -> np.ndarray:
    """A row for each list, with small numbers for its entries, equal ones for
    equal entries; the largest one fills up."""
    lengths = np.array([len(x) for x in lists], np.int64)
    values, at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]), return_inverse=True)
    out = np.full((len(lists), lengths.max() + 1), len(values), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = at
    return out


def _have_near(sizes: np.ndarray, profiles: list[bytes], labels: np.ndarray,
               first: np.ndarray, second: np.ndarray, met: np.ndarray | None = None) -> np.ndarray:
    """Which of the sets may be linked (``S.may_link``) with one of the other
    side, of another label and with no entry of ``met`` (``_coded``) in common."""
    lengths, keep = np.array([len(p) for p in profiles]), np.zeros(len(sizes), bool)
    met = np.zeros((len(sizes), 1), np.int64) if met is None else met
    of_row = np.zeros(met.max() + 1, bool)
    for length in np.unique(lengths[second]).tolist():
        cols = second[lengths[second] == length]
        table = np.stack([np.frombuffer(profiles[k], np.uint8) for k in cols]).astype(np.int16)
        for i in first.tolist():
            at = np.flatnonzero((labels[cols] != labels[i])
                                & (S.DEN * np.minimum(sizes[cols], sizes[i]) >= S.NUM * np.maximum(sizes[cols], sizes[i])))
            of_row[met[i]] = True
            of_row[-1] = False
            at = at[~of_row[met[cols[at]]].any(1)]
            of_row[met[i]] = False
            if not len(at):
                continue
            if lengths[i] == length:
                apart = np.abs(table[at] - np.frombuffer(profiles[i], np.uint8).astype(np.int16)).sum(1, dtype=np.int32)
                near = cols[at[apart <= S.differences(sizes[cols[at]], sizes[i])]]
            else:
                near = np.array([k for k in cols[at].tolist()
                                 if S.may_link(int(sizes[i]), profiles[i], int(sizes[k]), profiles[k])], np.int64)
            if len(near):
                keep[i] = True
                keep[near] = True
    return keep


def _block_links(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the nodes of pairs of blocks; of what a pair of blocks
    finds, a spanning forest leaves."""
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        first = (unit["own"] == unit["first"]).to_numpy()
        second = (unit["own"] == unit["second"]).to_numpy()
        return _forest(unit["node"].to_numpy(), unit["label"].to_numpy(),
                       [np.frombuffer(x, np.uint64) for x in unit["shingles"]],
                       np.flatnonzero(first), np.flatnonzero(second))

    return (near.join(_only(sets, near), "node").groupBy("signature", "first", "second")
            .applyInPandas(run, "a long, b long").distinct())


def _forest(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray],
            first: np.ndarray, second: np.ndarray) -> pd.DataFrame:
    """Links between the labels of the sets at ``first`` and those at
    ``second``, as a spanning forest. Only the counts of common elements are
    held for all pairs at once; a stripe of them is compared at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    both = np.zeros((len(first), len(second)), np.float32)
    for lo in range(0, len(shared), WIDE):      # a slice of the domain at a time
        part = shared[lo:lo + WIDE]
        has = np.zeros((len(sets), len(part)), np.float32)
        for k, s in enumerate(sets):
            own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
            at = np.searchsorted(part, own)
            has[k, at[part[at] == own]] = 1
        right = has[second].T
        for row in range(0, len(first), STRIPE):
            both[row:row + STRIPE] += has[first[row:row + STRIPE]] @ right
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for row in range(0, len(first), STRIPE):
        common, rows = both[row:row + STRIPE].astype(np.int64), first[row:row + STRIPE]
        union = sizes[rows][:, None] + sizes[second][None, :] - common
        linked = ((common > 0) & (S.DEN * common >= S.NUM * union)
                  & (labels[rows][:, None] != labels[second][None, :]))
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            i, j = rows[i], second[j]
            x, y = find(int(labels[i])), find(int(labels[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(nodes[i]), int(nodes[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         digest: Callable = S.digest) -> DataFrame:
    """doc_id, n_shingles, component_id, and component and text_key (the
    component's internal number and the text's hash). ``digest`` gives two
    64-bit hashes of a set, which together tell sets apart."""
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    sample = keep_table(_sample(texts), "ngram-sample")
    frequent = _frequent(sample)
    split: frozenset[int] = frozenset()
    number = partial(_number, split=split, digest=digest)
    hot = keep_table(_hot(sample, frequent, number), "ngram-hot")
    while True:
        rows = keep_table(_rows(_described(texts, frequent, number), hot), "ngram-rows")
        described = rows.filter("signature IS NULL").select("node", "doc.*")
        nodes = keep_table(
            described.filter("n_shingles > 0").groupBy("node")
            .agg(F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n_shingles"),
                 F.min("profile").alias("profile"), F.min("doc_id").alias("doc_id"),
                 (F.min("check") != F.max("check")).alias("several")), "ngram-nodes")
        # two of 64 bits alike: a handful among ten thousand million sets
        several = {r.node for r in nodes.filter("several").select("node").collect()}
        if several <= split:
            break
        split |= several
        number = partial(_number, split=split, digest=digest)
    buckets = rows.filter("signature IS NOT NULL").select("signature", "node")
    buckets = keep_table(_distinct_buckets(buckets), "ngram-buckets")
    labels = keep_table(buckets.select("node").distinct().withColumn("label", F.col("node")), "ngram-labels")

    # sets that are made later lie beside the first ones, in one folder
    folder = shared_scratch(docs.sparkSession, "ngram-texts")
    sets = tried = None
    first = 0
    for turn in range(ROUNDS):
        still = keep_table(_open(buckets, labels, nodes), "ngram-open")
        # the others are settled, and those of two nodes are by this round's pair
        buckets = still.filter("size > 2").select("signature", "node")
        pairs = _star_pairs(still, turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        near = keep_table(_may_link(keep_table(pairs, "ngram-pairs"), nodes), "ngram-near")
        sets = _with_sets(texts, near, nodes, sets, number, folder)
        new = keep_table(_linked(near, sets), "ngram-links")
        found = new.count()
        first = first or found
        labels = components(labels, new) if found else labels
        tried = near if tried is None else tried.unionByName(near)
        if found * 20 <= first:
            break

    still = keep_table(_open(buckets, labels, nodes), "ngram-open")
    large = keep_table(_large(still), "ngram-large")
    pairs = keep_table(_small_pairs(still).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
    near = keep_table(_may_link(pairs, nodes), "ngram-near")
    blocks = keep_table(_block_near(large, nodes), "ngram-blocks")
    need = near.unionByName(blocks.select(F.col("node").alias("a"), F.col("node").alias("b")))
    sets = _with_sets(texts, need, nodes, sets, number, folder)
    new = keep_table(_linked(near, sets).unionByName(_block_links(blocks, sets)), "ngram-links")
    labels = components(labels, new)

    joined = nodes.join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("label", "node").alias("component"))
    ids = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = joined.select("node", "component").join(ids, "component")
    return described.select("doc_id", "text_key", "node", "n_shingles").join(of_node, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component", "text_key")


def _with_sets(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, sets: DataFrame | None,
               number: Callable, folder: str) -> DataFrame:
    """``sets`` (read from ``folder``) and those of the nodes of ``pairs`` that
    it lacks, which are written there too: one scan, however often sets are made."""
    need = _ends(pairs).distinct()
    if sets is not None:
        need = need.join(sets, "node", "left_anti")
    need = keep_table(need.join(nodes.select("node", "text_key"), "node"), "ngram-needed")
    if need.isEmpty():
        if sets is not None:
            return sets
        texts = texts.limit(0)
    more = _sets(texts, need, number)
    more.write.mode("append").parquet(folder)
    return texts.sparkSession.read.schema(more.schema).parquet(folder)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null
    ids last; of equal ids the least hash of the text, of equal rows any one).
    Rows with an empty set all stay. Which rows leave is settled on ids and
    hashes; only texts that may leave, or stay once of several, are shuffled."""
    placed = keep_table(join(docs, id_col, text_col).filter("n_shingles > 0")
                        .groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")),
                        "ngram-placed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = placed.groupBy("component").agg(F.min(order).alias("best"))
    rated = (placed.join(best, "component").withColumn("stays", order == F.col("best"))
             .filter("not stays or copies > 1").select("doc_id", "text_key", "stays"))
    listed = keep_table(rated, "ngram-listed")
    leaving, repeated = listed.filter("not stays"), listed.filter("stays")
    tid, tkey = free_name(docs, "_id"), free_name(docs, "_text_key")
    keyed = docs.withColumn(tid, docs[id_col]).withColumn(tkey, F.xxhash64(docs[text_col].cast("string")))
    perhaps = _perhaps_in(_key_map(listed, "text_key"))(F.col(tkey))

    def on(rows: DataFrame):
        return (F.col(tkey) == rows["text_key"]) & F.col(tid).eqNullSafe(rows["doc_id"])

    some = keyed.filter(perhaps)
    some = some.join(leaving, on(leaving), "left_anti")
    if not repeated.isEmpty():
        one = some.join(repeated, on(repeated), "left_semi").dropDuplicates([tid, tkey])
        some = some.join(repeated, on(repeated), "left_anti").unionByName(one)
    return keyed.filter(~perhaps).unionByName(some).drop(tid, tkey)
