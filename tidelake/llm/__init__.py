"""Operators for preparing training text: dedup, filters, mixing, token output.

Nothing else in tidelake imports this subpackage.
"""
