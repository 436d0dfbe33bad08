"""All registered queries, gathered from the topic modules."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOPICS = ["preparing", "profiling", "sourcing", "measuring", "connecting", "publishing", "operating"]

for _topic in TOPICS:
    _module = importlib.import_module(f"workload.{_topic}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
