"""Composed flows: the shared preparation chain (``prepare``), the flagship path
(``flagship``), the registered queries (``catalog``) and their DuckDB twins (``oracle``)."""
