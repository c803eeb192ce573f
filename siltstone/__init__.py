"""Curation and audit of training data on Spark."""
