"""Composite operators: whole batch jobs."""
