"""Compositions of operators: reports, full runs and the query catalogue."""
