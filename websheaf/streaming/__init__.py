"""Log rules as Structured Streaming queries and their batch forms."""
