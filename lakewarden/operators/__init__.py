"""Relational operators: nodes, language, sampling, judging, vectors, metrics, reports."""
