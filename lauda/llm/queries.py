"""All queries of the subpackage and the SQL of those that SQL can express."""

from lauda.llm import char_queries, document_queries, pii_queries, vocabulary_queries

QUERIES = pii_queries.QUERIES | char_queries.QUERIES | vocabulary_queries.QUERIES | document_queries.QUERIES
ORACLE = pii_queries.ORACLE | char_queries.ORACLE | vocabulary_queries.ORACLE | document_queries.ORACLE
