"""Relational building blocks of the reconciliation: references, pairs, stages, rules, exceptions."""
