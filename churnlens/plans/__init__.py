"""Registered queries (q_*.py, wired by catalog.py into __spark_entry__) and the batch jobs."""
