"""Operators for preparing training data.

Each module holds one operator with its own interface; ``queries`` derives the
registered results from them. Nothing outside this folder imports it.
"""
