"""Ready-made jobs: stand-in domain tables and the query catalogue."""
