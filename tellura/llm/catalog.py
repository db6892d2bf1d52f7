"""The operators' queries over the driver tables, and DuckDB SQL for them."""

from __future__ import annotations

import corpus_pipeline
from tellura.llm import queries, sql

QUERIES = dict(queries.QUERIES) | {"pipeline": corpus_pipeline.run}
ORACLES = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
