"""Gradus: profiling, sampling, feature building and corpus preparation for large tables, written for Spark."""
