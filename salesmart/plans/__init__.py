"""Dimension, fact, mart and report plans."""
