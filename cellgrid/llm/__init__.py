"""Operators of a training-data pipeline (packing, near-duplicates, mixing,
line dedup, classifiers, token files, web archives, vector search).

Nothing else in the library imports this subpackage; the queries over the
test tables are in ``queries.py`` and their SQL in ``oracle.py``.
"""
