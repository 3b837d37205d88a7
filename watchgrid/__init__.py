"""Spark jobs for short located reports, area alerts and training-data text."""
