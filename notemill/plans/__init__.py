"""The queries: what each takes from the tables, and the same in SQL where that can be said."""

from . import batch_queries, document_queries, hierarchy_queries, page_queries, scoring_queries, url_queries

_MODULES = (url_queries, page_queries, hierarchy_queries, document_queries, batch_queries, scoring_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
