"""Operators for building training corpora, apart from the graph engine.

Nothing outside this subpackage imports it. Each module holds one operator;
``registry`` maps them to the ``opN_*`` queries.
"""
