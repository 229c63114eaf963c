"""Compositions of operators: feature jobs, analyses and the experiment."""
