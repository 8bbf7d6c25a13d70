"""Every query of the library outside llm, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: file a query under its operator's id, with its twin."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


from . import (  # noqa: E402
    claim_queries,  # noqa: F401
    closure_queries,  # noqa: F401
    log_queries,  # noqa: F401
    matrix_queries,  # noqa: F401
    registry_queries,  # noqa: F401
    score_queries,  # noqa: F401
    snapshot_queries,  # noqa: F401
    source_queries,  # noqa: F401
)
from . import stream_queries  # noqa: E402, F401  # after the batch queries, whose SQL it shares
