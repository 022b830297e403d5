"""Training-data operators: packing, dedup, language ID, joins, scans, counts.

Each operator is a module with a general interface (texts, spans, tables) and
``queries.py`` holds the thin registered queries.  Nothing else in the library
imports this subpackage.
"""
