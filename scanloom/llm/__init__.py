"""Operators for training-data pipelines: one module an operator, each with its query."""
