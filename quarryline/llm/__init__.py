"""Operators for preparing training data, each usable on its own.

Nothing else in the library imports this subpackage.
"""
