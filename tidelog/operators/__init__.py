"""Operators over records, segments, producers and groups, as DataFrame transformations."""
