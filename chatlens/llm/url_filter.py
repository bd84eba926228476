"""URL filters by hash prefixes of host-suffix / path-prefix expressions.

Each distinct (host, path) is expanded into expressions: a suffix of the host
at a label boundary followed by a prefix of the path that ends in a slash (or
by no path). A rule is filed under its host and the part of its path up to the
last slash. URLs and rules meet in an equi-join on a short prefix of the
SHA-256 of the expression; a meeting counts if the full digests agree and the
url's path starts with the whole path of the rule. Of several rules the
longest wins (host and path together, then the longer host; of equal rules
block comes before allow). Without a rule the verdict is ``default``.

Only built-in functions. The expansion stops at the greatest depth that any
rule has, so a long URL makes no more expressions than rules can meet.

Null URLs and URLs without ``://`` have an empty host and path, which no rule
fits. A row in gives a row out (repeated rows are folded before the expansion
and unfolded after it). Rules with a null or empty host fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import ascii_lower, pin

SHORT = 8       # hex digits of the digest in the equi-join


def url_host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _expressions(host: str, path: str, labels: int, slashes: int) -> Column:
    """Expressions of the columns ``host`` and ``path``."""
    return F.expr(f"""
      flatten(transform(sequence(1, least({labels}, size(split({host}, '[.]')))), j ->
        transform(sequence(0, least({slashes}, size(split({path}, '/')) - 1)), k ->
          concat(array_join(slice(split({host}, '[.]'), -j, j), '.'),
                 if(k = 0, '', concat(array_join(slice(split({path}, '/'), 1, k), '/'), '/'))))))
    """)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``rules`` has host, path and action (allow or block). Returns page_id,
    host, path, rule (host and path of the rule, or null) and verdict."""
    filed = (rules.select(ascii_lower(F.col("host")).alias("r_host"),
                          F.coalesce("path", F.lit("")).alias("r_path"),
                          F.col("action").alias("r_action"))
             .filter(F.coalesce("r_host", F.lit("")) != "")
             .withColumn("r_key", F.concat("r_host", F.regexp_extract("r_path", r"^((?s).*/)?", 0)))
             .withColumn("r_digest", F.sha2("r_key", 256))
             .withColumn("short", F.substring("r_digest", 1, SHORT)))
    deep = filed.agg(F.max(F.size(F.split("r_host", "[.]"))),
                     F.max(F.size(F.split("r_key", "/")) - 1)).first()

    host, path = url_host_path(pages[url_col])
    seen = (pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
            .groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies")))
    met = (pin(seen, expression=_expressions("host", "path", deep[0] or 1, deep[1] or 0))
           .withColumn("expression", F.explode("expression"))
           .withColumn("digest", F.sha2("expression", 256))
           .withColumn("short", F.substring("digest", 1, SHORT))
           .join(filed, "short", "left"))
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    best = F.max(F.when(fits, F.struct(
        (F.length("r_host") + F.length("r_path")).alias("len"), F.length("r_host").alias("host_len"),
        F.col("r_action").alias("action"), F.concat("r_host", "r_path").alias("rule"))))
    return (met.groupBy("page_id", "host", "path", "copies").agg(best.alias("best"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict"),
                    F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .drop("copy"))
