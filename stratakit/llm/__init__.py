"""Training-data pipeline operators.

Each module holds one operator with its own general interface; ``queries``
registers the thin queries (and their DuckDB SQL) over the given tables.
Nothing outside this package imports it, except ``corpus_pipeline.py`` and the
guarded lines of ``__spark_entry__.py``.
"""
