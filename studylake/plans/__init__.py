"""Whole jobs: they read, compose operators, write a dataset version and record it in the catalog."""
