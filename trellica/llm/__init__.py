"""Operators for preparing training text at scale; self-contained, nothing else in the package imports it."""
