"""Conflict-free merging and analysis of replicated data on Spark."""
