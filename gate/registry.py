"""All queries and their SQL, merged."""
from gate import catalog, compare, extraction, history, kept, matching, quality, scalars, state, streams

MODULES = [compare, extraction, history, matching, quality, catalog, scalars, state, streams, kept]
QUERIES, SQL = {}, {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    SQL.update(_m.SQL)
