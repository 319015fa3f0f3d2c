"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with its
own interface, and the thin query ``opN_<name>`` that applies it to a whole table.
"""
