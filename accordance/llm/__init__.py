"""Operators for preparing training data at scale; one module an operator, queries in ``queries``."""
