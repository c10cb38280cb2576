"""All queries outside the llm subpackage, with their SQL twins."""

from __future__ import annotations

from tidemark.plans import decision_queries, keyed_queries, page_queries, resolve_queries, scan_queries, series_queries, stream_queries, text_queries  # noqa: F401  they register their queries
from tidemark.plans import capital_queries, crawl_queries, cycle_queries, portfolio_queries, rule_queries, serving_queries, stored_queries  # noqa: F401, I001  builds on the twins of those
from tidemark.plans.define import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = scan_queries.q_flagship_scan
