"""Whole jobs: inspection report, ingest, template export, and the query catalog."""
