"""Operators for large training corpora, each a Spark job over whole tables.

Nothing outside this subpackage imports it; ``queries.py`` lists what the
entry module registers.
"""
