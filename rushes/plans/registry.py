"""All registered footage queries and their DuckDB SQL."""

from rushes.plans import colour, mosaic, playback, queries

MODULES = (queries, playback, mosaic, colour)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
