"""The SQL that each query's rows are checked against, by query name."""

from __future__ import annotations

from tidemark.plans import accounts, books, live, series

ORACLES: dict[str, str] = {**series.ORACLES, **books.ORACLES, **accounts.ORACLES, **live.ORACLES}
