"""Operators for large text corpora, one module each.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
