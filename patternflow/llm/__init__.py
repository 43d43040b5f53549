"""Operators for preparing training data at scale.

Each module holds one operator; ``queries`` applies them to the ``documents`` table.
Nothing else in the library imports this subpackage.
"""
