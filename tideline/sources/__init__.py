"""Readers, spec-driven ingestion and writers."""
