"""Readers and writers: gateway JSON, bank text, ledger CSV and XML, and the test-table adapter."""
