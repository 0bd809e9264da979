"""Readers and writers of logs, lists, feeds, caches and manifests."""
