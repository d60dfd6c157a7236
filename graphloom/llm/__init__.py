"""Operators for building text collections for language models.

Nothing outside this subpackage imports it.
"""
