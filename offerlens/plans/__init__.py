"""Whole jobs: compositions of operators."""
