"""All queries of the library but those of the optional subpackage."""

from __future__ import annotations

from pulsegrid.plans import analytics, feeds, incidents, merging, outcomes, questions, reports, timelines

flagship = analytics.ask_breakdown
QUERIES = analytics.QUERIES | incidents.QUERIES | feeds.QUERIES | questions.QUERIES | timelines.QUERIES | merging.QUERIES | outcomes.QUERIES | reports.QUERIES
ORACLE_SQL = analytics.ORACLE_SQL | incidents.ORACLE_SQL | feeds.ORACLE_SQL | questions.ORACLE_SQL | timelines.ORACLE_SQL | merging.ORACLE_SQL | outcomes.ORACLE_SQL | reports.ORACLE_SQL
