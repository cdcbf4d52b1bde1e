"""Queries over the given tables, and the SQL they are checked against.

The tables hold no source code, so each query derives its input from them: facts
straight from columns, source files as text made from columns.  The SQL computes
the expected facts from the same columns and never sees the text.
"""
