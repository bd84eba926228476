"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.session import configure, shared_scratch

# The white space that separates words: space and the five ASCII controls.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the registered queries: the library's own, and Arrow
    batches small enough that one of long texts fits a Python worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it
    back: cuts the lineage, survives lost executors, and gives the planner the
    real size (so a broadcast is only chosen behind a check of the size)."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or empty."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name that no column of ``df`` has (any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row. Catalyst may copy a plain
    projection into every expression above it, also into lambda bodies; it
    does not copy the input of a generator."""
    box = free_name(df, "_pin")
    boxed = df.select("*", F.explode(F.array(F.struct(
        *[c.alias(n) for n, c in cols.items()]))).alias(box))
    return boxed.select(*[F.col(f"`{c}`") for c in df.columns],
                        *[F.col(box)[n].alias(n) for n in cols])


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter table as SQL literals (no RDD, no Arrow)."""
    names = [f.split()[0] for f in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0])
                                       for f in schema.split(",")])
    lit = lambda v: ("NULL" if v is None else str(v) if isinstance(v, (int, float))
                     else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'")
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(",")])
