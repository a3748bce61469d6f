"""Everyday work on analytic tables as Spark DataFrame jobs.

``functions``  column expressions
``sources``    Parquet scans, catalog tables, scratch space
``operators``  contracts, relational steps, table upkeep, access declarations
``plans``      the registered queries and the SQL that describes their rows
"""
