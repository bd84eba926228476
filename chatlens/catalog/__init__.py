"""Registered queries: one entry per operator of SURVEY §2, each with the
DataFrame call on the driver-derived chat tables and, where SQL can say it,
the equivalent DuckDB query used as the correctness oracle."""

from __future__ import annotations

from chatlens.catalog.base import REGISTRY, Entry  # noqa: F401


def load_all() -> dict:
    from chatlens.catalog import (  # noqa: F401
        channels_q, content_q, graph_q, ingest_q, quality_q, reactions_q, replies_q, store_q,
        time_q, users_q)
    from chatlens.catalog import report_q, service_q  # noqa: F401  (compose bodies of the others)
    return REGISTRY
