"""Conditions, joins, pages, terminals and time buckets as DataFrame plans."""
