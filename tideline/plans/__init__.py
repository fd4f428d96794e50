"""Workflows, charts, reports and the registered analytics queries."""
