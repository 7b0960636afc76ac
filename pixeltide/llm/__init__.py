"""Training-data operators: tokenising, de-duplication, filtering and scoring of text tables.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
