"""Training-data operators: scoring, near-duplicate detection, scans, tokenising and sharding.

Nothing outside this subpackage imports it.
"""
