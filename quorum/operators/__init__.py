"""Operators on labelled sets: sampling, counting, models, pseudo-labels, scores."""
