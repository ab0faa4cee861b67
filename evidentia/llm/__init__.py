"""Operators of a training-data pipeline, each from a table of texts to a table of decisions.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
production queries; the operators keep their own general interfaces.
"""
