"""Spark jobs for rate panels, news tables and training-data corpora."""
