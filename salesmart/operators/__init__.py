"""Distributed operators: dense keys, key lookups, orphan audit, ranking."""
