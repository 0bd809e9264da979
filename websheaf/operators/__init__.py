"""Relational operators: fusion, joins, aggregates, windows, ranking, pages, crawl."""
