"""All queries of this folder and the SQL of those that SQL can state."""

from __future__ import annotations

import corpus_pipeline
from quillsift.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
