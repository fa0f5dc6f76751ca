"""All registered queries over the driver tables, and the DuckDB equivalents of those that SQL can express."""

from __future__ import annotations

from . import q_changes, q_faces, q_files, q_filters, q_scalars, q_summaries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
