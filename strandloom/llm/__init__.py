"""Operators for preparing training data: runs, patterns, shared spans, leaks, tokens, cut texts."""
