"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import endpoint, evaluation, evidence, graph, identity, industrial, jobs, knowledge, ledger, network, operations, relational, response, retrieval, storage, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "identity_user_hour_zscores"
