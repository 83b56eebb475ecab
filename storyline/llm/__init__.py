"""Operators for building training corpora: one module an operator, queries in ``queries``."""
