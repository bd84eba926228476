"""Reading the chat tables from a relational database (the reference keeps
them in PostgreSQL or SQLite).

Spark's JDBC source reads one table in ``partitions`` parallel range scans
over a numeric key; the key's bounds come from one small ``min/max`` query.
Only the columns of the declared schema are read, and an optional tenant
predicate is handed to the database. (Untested here: no database may run in
this environment; the driver jar must be on the classpath.)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chatlens.functions.columns import TENANT_ID_PATTERN
from chatlens.sources.schema import SCHEMAS, conform


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict,
                    key: str = "id", partitions: int = 64, tenant: str | None = None
                    ) -> DataFrame:
    if tenant is not None and not re.fullmatch(TENANT_ID_PATTERN.strip("^$"), tenant):
        raise ValueError("invalid tenant id")      # it is spliced into the SQL text
    cols = ", ".join(f.name for f in SCHEMAS[table].fields)
    where = f" WHERE tenant_id = '{tenant}'" if tenant else ""
    bounds = spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}{where}) b",
                             properties=properties).first()
    src = f"(SELECT {cols} FROM {table}{where}) t"
    if bounds is None or bounds.lo is None:
        return conform(spark.read.jdbc(url, src, properties=properties), table)
    df = spark.read.jdbc(url, src, column=key, lowerBound=int(bounds.lo),
                         upperBound=int(bounds.hi) + 1, numPartitions=partitions,
                         properties=properties)
    return conform(df, table)
