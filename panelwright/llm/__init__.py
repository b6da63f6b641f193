"""Operators that prepare training text: one module each, queries in ``queries``."""
