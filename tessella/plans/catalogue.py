"""All queries of the library, and their SQL."""

from __future__ import annotations

from tessella.plans import clustering, extras, rasters, sampling, shapes, statements, tasks, training

MODULES = (sampling, rasters, clustering, training, tasks, statements, extras, shapes)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
