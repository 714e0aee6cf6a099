"""All reconciliation queries by name, and the SQL that states the same results."""

from __future__ import annotations

from trisettle.plans import accuracy, cascade, evidence, lifecycle, matching, proofs, queue, records, summaries, text, views

QUERIES = {}
ORACLE_SQL = {}
for module in (accuracy, cascade, matching, queue, evidence, lifecycle, proofs, records, summaries, text, views):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
