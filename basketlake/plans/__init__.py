"""Compositions of operators: staged tables, jobs, and the query catalogue."""
