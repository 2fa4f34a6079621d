"""Relational operators: windows, joins, aggregates, the failover fold."""
