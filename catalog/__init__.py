"""Queries over the given tables and their SQL twins."""

from . import edges, oracle, spark_queries

QUERIES = spark_queries.QUERIES | edges.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | edges.ORACLE_SQL
