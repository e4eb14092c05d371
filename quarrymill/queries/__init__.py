"""Queries over the test tables, one module for each group of operators; each has QUERIES and ORACLE_SQL."""
