"""Whole jobs, the test-table views, and the registered queries."""
