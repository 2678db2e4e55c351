"""Operators of a training-data pipeline over web-scale text tables.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
