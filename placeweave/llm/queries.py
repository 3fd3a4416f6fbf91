"""All queries of this subpackage, and their SQL where DuckDB can express them."""

from . import queries_labels, queries_rows, queries_text

QUERIES = {**queries_text.QUERIES, **queries_rows.QUERIES, **queries_labels.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries_rows.ORACLE_SQL}
