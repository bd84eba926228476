"""Versioned storage of a set of tables: a load writes only what it touches, and
all its tables become visible at once.

Rows lie under ``<root>/<table>/gen=<load>/tenant_id=.../part=...``; ``part`` is
the UTC day of a fact or a bucket of a key. A manifest lists the live
(table, tenant, part, gen). A load stages its rows in folders of its own
generation: ``append`` adds them to what a part holds, ``replace`` puts them in
the place of whole parts. ``commit`` writes the next manifest; that one write is
what readers see, so a load that fails midway leaves the old set visible, and a
second load of the same version fails instead of undoing the first.

Every staged row passes the write gate in the same pass: an ``Observation``
counts the rows and those of another tenant, and a commit with any of these is
refused.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_MANIFEST = "table string, tenant_id string, part string, gen string"


class RefusedWrite(ValueError):
    pass


def day_part(col: str) -> Column:
    return F.date_format(F.to_date(col), "yyyy-MM-dd")


def bucket_part(*cols: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("string")


# Where a row of a table lies; other tables by bucket of their ``id``.
PARTS = {
    "messages": lambda: day_part("created_at"),
    "reactions": lambda: day_part("reacted_at"),
    "message_mentions": lambda: bucket_part("message_id"),
    "server_members": lambda: bucket_part("user_id"),
    "sync_ledger": lambda: bucket_part("channel_id"),
    "interaction_parts": lambda: day_part("day"),
    "daily_parts": lambda: day_part("day"),
    "open_edges": lambda: F.lit("all"),
    "user_numbers": lambda: bucket_part("user_id"),
    "author_maps": lambda: day_part("day"),
}


class TableStore:
    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant
        self._see(self.version())

    def _see(self, version: int) -> None:
        self.at = version
        own = self.manifest().filter(F.col("tenant_id") == self.tenant)
        self.held = {r[0] for r in own.select("table").distinct().collect()} if version else set()
        self._open_load()

    def _open_load(self) -> None:
        self.gen = uuid.uuid4().hex[:12]
        self.staged: dict[str, tuple[DataFrame, dict]] = {}     # table → parts that it replaces, counts

    # -- reading --------------------------------------------------------------
    def version(self) -> int:
        """The last committed version; 0 before the first."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest/v=*/_SUCCESS")
        fs = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = fs.globStatus(pattern) or []
        return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.at if version is None else version
        if not v:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/_manifest/v={v}")

    def _files(self, name: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([f for f in schema.fields if f.name not in ("tenant_id", "part", "gen")]
                            + [T.StructField(c, T.StringType()) for c in ("gen", "tenant_id", "part")])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}/gen=*")

    def read(self, name: str, schema: T.StructType, first: str | None = None, last: str | None = None,
             parts: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The tenant's live rows of a table; of the parts from ``first`` to
        ``last``, or of those listed in ``parts``. The partition folders of the
        others are not opened."""
        if version is None and name not in self.held:
            return self.spark.createDataFrame([], schema)
        live = self.manifest(version).filter((F.col("table") == name) & (F.col("tenant_id") == self.tenant))
        rows = self._files(name, schema).filter(F.col("tenant_id") == self.tenant)
        if first is not None:
            rows = rows.filter(F.col("part") >= first)
        if last is not None:
            rows = rows.filter(F.col("part") <= last)
        if parts is not None:
            live = live.join(parts.select("part").distinct(), "part", "left_semi")
        return rows.join(live.select("part", "gen"), ["part", "gen"], "left_semi").select(*schema.names)

    # -- writing --------------------------------------------------------------
    def _stage(self, name: str, df: DataFrame, parts: DataFrame | None, in_place: bool = False) -> dict:
        if name in self.staged:
            raise ValueError(f"{name} is staged already")
        part = PARTS.get(name, lambda: bucket_part("id"))()
        seen = Observation(f"{name}-{self.gen}")
        own = F.col("tenant_id").eqNullSafe(F.lit(self.tenant))
        out = df.withColumn("part", F.coalesce(part, F.lit("none"))).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(~own, 1)).alias("foreign"))
        out = out if in_place else out.hint("rebalance", "part")
        (out.write.option("compression", "zstd").partitionBy("tenant_id", "part")
         .parquet(f"{self.root}/{name}/gen={self.gen}"))
        try:
            counts = dict(seen.get)
        except Py4JJavaError:       # a frame that is empty by its plan alone is not observed
            counts = {"rows": 0, "foreign": 0} if df.isEmpty() else None
            if counts is None:
                raise
        self.staged[name] = (parts, counts)
        return counts

    def append(self, name: str, df: DataFrame) -> dict:
        """Add rows; returns the counts of the pass (rows, foreign)."""
        return self._stage(name, df, None)

    def replace(self, name: str, df: DataFrame, parts: DataFrame | None = None, in_place: bool = False) -> dict:
        """Put ``df`` in the place of the listed parts (a frame with ``part``),
        or of the tenant's whole table. ``in_place``: its rows come from the
        table's own files, unshuffled, so they lie by part already."""
        if parts is None:
            parts = self.manifest().filter((F.col("table") == name) & (F.col("tenant_id") == self.tenant))
        return self._stage(name, df, parts.select("part").distinct(), in_place)

    def commit(self) -> int:
        """Publish all that was staged; nothing of it was visible before."""
        foreign = {n: c["foreign"] for n, (_, c) in self.staged.items() if c["foreign"]}
        if foreign:
            raise RefusedWrite(f"rows of another tenant: {foreign}")
        keys = ["table", "tenant_id", "part"]
        after = self.manifest()
        for name, (parts, counts) in self.staged.items():
            here = F.lit(name).alias("table"), F.lit(self.tenant).alias("tenant_id"), F.col("part")
            if parts is not None:
                after = after.join(parts.select(*here), keys, "left_anti")
            if counts["rows"]:
                new = (self.spark.read.parquet(f"{self.root}/{name}/gen={self.gen}")
                       .select(F.col("part").cast("string").alias("part")).distinct())
                after = after.unionByName(new.select(*here, F.lit(self.gen).alias("gen")))
        after.write.parquet(f"{self.root}/_manifest/v={self.at + 1}")
        self._see(self.at + 1)
        return self.at
