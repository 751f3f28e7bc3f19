"""Operators for preparing training text, and their registered queries.

Nothing outside this folder imports it; it may be deleted without harm to the rest.
"""
