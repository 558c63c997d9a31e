"""All registered queries and the SQL that states their results."""

from __future__ import annotations

from quillsift.plans import (
    catalog_oracle,
    catalog_queries,
    eval_oracle,
    eval_queries,
    retrieval_oracle,
    retrieval_queries,
    text_queries,
    text_queries_oracle,
)

QUERIES = {
    **retrieval_queries.QUERIES,
    **text_queries.QUERIES,
    **eval_queries.QUERIES,
    **catalog_queries.QUERIES,
}
ORACLES = {
    **retrieval_oracle.ORACLES,
    **text_queries_oracle.ORACLES,
    **eval_oracle.ORACLES,
    **catalog_oracle.ORACLES,
}
