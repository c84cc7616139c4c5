"""Training-data operators: the ten dealt operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
