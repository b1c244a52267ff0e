"""Corpus preparation operators for large text collections.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
