"""Column functions: URLs, text, dates, snippets."""
