"""The registered queries, by subject, each module with ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from loomgrid.plans import graphs, ingest, models, panels, problems, reports, scores

MODULES = (problems, ingest, panels, graphs, scores, reports, models)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
