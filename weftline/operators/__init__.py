"""Operators: search, ranking, chunking, evaluation, operations, state."""
