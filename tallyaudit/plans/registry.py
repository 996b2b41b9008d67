"""All registered queries."""

from . import (  # noqa: F401
    audit_queries, compare_queries, forensic_queries, list_queries, source_queries, stream_queries, text_queries,
)
from .catalog import ORACLE, QUERIES  # noqa: F401
