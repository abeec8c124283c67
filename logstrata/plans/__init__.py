"""Compositions of operators: the cohort matrix and the multi-repository batch."""
