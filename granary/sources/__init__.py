"""Readers of JSON lines, JSON arrays and texts, adapters of public chat schemas, and writers."""
