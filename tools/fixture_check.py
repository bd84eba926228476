"""Check that the Spark and SQL forms of the fixture rules give equal tables."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from chatlens.session import local_session  # noqa: E402
from chatlens.sources.fixtures import ORACLE_PREFIX, chat_tables  # noqa: E402
from tools.oracle_check import TABLES, rows_of  # noqa: E402

NAMES = ["users", "servers", "channels", "emojis", "server_members", "messages",
         "message_mentions", "reactions", "extraction_jobs", "usage_logs", "app_users"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ct = chat_tables(spark, sf_dir)
    for n in sys.argv[2:] or NAMES:
        sdf = ct[n]
        cur = con.execute(ORACLE_PREFIX + f"SELECT * FROM {n}")
        sc, sr = rows_of(sdf.columns, sdf.collect())
        dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
        if sc != dc:
            print("COLS", n, sc, dc)
        elif sr != dr:
            ss, ds = set(sr), set(dr)
            print("MISMATCH", n, len(sr), len(dr), list(ss - ds)[:2], list(ds - ss)[:2])
        else:
            print("ok", n, len(sr))


if __name__ == "__main__":
    main()
