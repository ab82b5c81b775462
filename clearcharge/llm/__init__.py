"""Operators for preparing training data: counting, near-copies, search, scoring, cleaning."""
