"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import q_agent, q_agg, q_build, q_curate, q_dataset, q_files, q_records, q_search, q_sources, q_validate  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
