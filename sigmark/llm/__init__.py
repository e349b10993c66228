"""Operators that turn a raw text corpus into training sequences.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` holds the thin registered queries.
"""
