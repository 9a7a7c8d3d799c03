"""Operators over whole tables: near-duplicates, mixing, message trees, quality gates and token streams."""
