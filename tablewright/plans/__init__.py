"""Registered queries and the SQL that describes the rows they must return."""
