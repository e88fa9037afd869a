"""Whole runs: a single model, bagging, stacking, and their reports."""
