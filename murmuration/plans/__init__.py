"""Composed analyses, the query catalog and its SQL oracle."""
