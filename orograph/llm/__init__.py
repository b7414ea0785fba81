"""Operators that prepare training text: one module each, plus the registered queries."""
