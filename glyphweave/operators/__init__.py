"""Relational operators: blocking, joins, clustering, linkage."""
