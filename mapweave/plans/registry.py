"""All queries of the core and the SQL beside them."""

from mapweave.plans import dealt, dealt_sql, dialect_queries, map_queries, source_queries

QUERIES = dealt.QUERIES | dialect_queries.QUERIES | map_queries.QUERIES | source_queries.QUERIES
SQL = dealt_sql.SQL | dialect_queries.SQL | map_queries.SQL | source_queries.SQL
