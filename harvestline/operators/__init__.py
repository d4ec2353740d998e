"""Operators: quality rules, latest rows, as-of values, aggregates, joins, state tables."""
