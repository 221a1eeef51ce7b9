"""Readers for delivery and match-info files, the test-table adapter, and shared storage."""
