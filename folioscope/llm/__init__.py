"""Operators for large-scale training data. Nothing outside this subpackage
imports it; ``queries`` and ``oracle_sql`` in :mod:`.queries` register it."""
