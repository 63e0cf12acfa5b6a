"""All registered queries."""

from corpuslens.plans import blocks, changes, corpus, coverage, flow, hygiene, mining, reuse, runs, storage, streams  # noqa: F401
from corpuslens.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
