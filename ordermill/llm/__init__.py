"""Operators for building training corpora: one module per operator, all built on Spark jobs."""
