"""Every query of this subpackage and its SQL."""

from iolens.llm import event_queries, text_queries

_MODULES = [event_queries, text_queries]
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
