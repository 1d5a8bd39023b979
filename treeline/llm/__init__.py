"""Training-data operators over a corpus of documents, one module per operator.

Nothing else in ``treeline`` imports this subpackage; ``queries.py`` holds the thin
``opN_<name>`` queries and ``oracles.py`` their SQL.
"""
