"""Exports of a result DataFrame: CSV, JSON, Markdown, TSV.

Each is a distributed write (one file per partition); nested values are
turned into JSON text first, as the reference's export does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Values are written as they are: Spark's writer would trim white space.
_UNTRIMMED = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, NULL as empty, quotes only around values with a comma, quote
    or newline (quotes doubled)."""
    (_flat(df).write.mode(mode).options(**_UNTRIMMED).option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", "")
     .option("quoteAll", False).csv(path))


def export_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, NULL as empty, quotes only around values with a tab, quote or
    newline (quotes doubled), so such a value does not break its row."""
    (_flat(df).write.mode(mode).options(**_UNTRIMMED).option("header", True).option("sep", "\t").option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path))


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def markdown_lines(df: DataFrame, order: list | None = None) -> DataFrame:
    """The Markdown table as (line_no, line) rows: header, separator, then
    one line per row (NULL → _null_, '|' escaped, newline → space). With
    ``order`` the rows are range-sorted and numbered by partition position
    (increasing, not contiguous) so no single task sees every row."""
    names = df.columns
    flat = _flat(df)
    cells = [F.coalesce(F.regexp_replace(F.regexp_replace(F.col(f"`{n}`").cast("string"),
                                                         r"\|", r"\\|"), "\n", " "),
                        F.lit("_null_")) for n in names]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = flat.select(line.alias("line"), *[F.col(f"`{n}`") for n in names])
    if order:
        body = body.orderBy(*order)
    body = body.select((F.monotonically_increasing_id() + 2).alias("line_no"), "line")
    head = df.sparkSession.createDataFrame(
        [(0, "| " + " | ".join(names) + " |"), (1, "| " + " | ".join("---" for _ in names) + " |")],
        "line_no long, line string")
    return head.unionByName(body)


def export_markdown(df: DataFrame, path: str, order: list | None = None,
                    mode: str = "overwrite") -> None:
    """Write the lines sorted by line number (part files in order)."""
    markdown_lines(df, order).orderBy("line_no").select("line").write.mode(mode).text(path)
